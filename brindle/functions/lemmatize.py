"""A rule-based English lemmatiser, pluggable wherever tokens are made."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from brindle.session import ship

#: Irregular forms.
IRREGULAR = {
    "are": "be", "is": "be", "was": "be", "were": "be", "been": "be", "am": "be", "has": "have", "had": "have", "did": "do", "done": "do",
    "went": "go", "gone": "go", "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse",
    "people": "person", "better": "good", "best": "good", "made": "make", "wrote": "write", "written": "write", "took": "take", "taken": "take",
}


def lemma(word: str) -> str:
    """The lemma of a lower-case word by its ending."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("sses", "shes", "ches", "xes", "zes")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is")):
        return word[:-1]
    for end in ("ing", "ed"):
        stem = word.removesuffix(end)
        if stem != word and len(stem) > 2 and any(v in stem for v in "aeiouy"):
            if len(stem) > 3 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if len(stem) > 2 and stem[-1] in "cgvz" else stem
    return word


def lemmatize(tokens: Column) -> Column:
    """An array of tokens as an array of distinct lemmas, by batches."""
    if session := SparkSession.getActiveSession():
        ship(session)

    @F.pandas_udf("array<string>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda words: None if words is None else list(dict.fromkeys(map(lemma, words))))

    return run(tokens)
