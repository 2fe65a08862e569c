"""Column functions for what needs Unicode rules or the title grammar. Arrow batches, never row by row through pickles."""

from __future__ import annotations

import html
from dataclasses import asdict

import pandas as pd

from tomewise.functions import titles
from tomewise.functions.lazy import column_function

TITLE = "key string, volume string, labels array<string>, editions array<string>, search_text string, whole_key string, key_without_volume_subtitle string, split_edition boolean"
STAGES = "array<struct<name:string,params:map<string,string>,refinements:array<map<string,string>>>>"


def _each(values: pd.Series, f) -> pd.Series:
    return values.map(f, na_action="ignore")


@column_function("string")
def nfkc(values: pd.Series) -> pd.Series:
    return _each(values, titles.nfkc)


@column_function("string")
def unescape_html(values: pd.Series) -> pd.Series:
    return _each(values, html.unescape)


@column_function("string")
def title_key(values: pd.Series) -> pd.Series:
    return _each(values, titles.title_key)


@column_function("string")
def bare_key(values: pd.Series) -> pd.Series:
    return _each(values, titles.bare)


@column_function("string")
def search_words(values: pd.Series) -> pd.Series:
    return _each(values, titles.search_words)


@column_function("string")
def search_creator(values: pd.Series) -> pd.Series:
    return _each(values, titles.search_creator)


@column_function("string")
def volume_of(values: pd.Series) -> pd.Series:
    return _each(values, titles.volume_of)


@column_function(TITLE)
def read_title(title: pd.Series, series: pd.Series) -> pd.DataFrame:
    """A null title reads as an empty one."""
    read = [asdict(titles.read_title(t or "", s)) for t, s in zip(title, series, strict=True)]
    return pd.DataFrame(read, columns=[c.split()[0] for c in TITLE.split(", ")])


@column_function(STAGES)
def search_stages(title: pd.Series, authors: pd.Series, series: pd.Series) -> pd.Series:
    return pd.Series([[{"name": s.name, "params": s.params, "refinements": list(s.refinements)} for s in titles.search_stages(t or "", a or "", x)] for t, a, x in zip(title, authors, series, strict=True)], index=title.index)
