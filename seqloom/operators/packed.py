"""Several values packed in one field: a parsing expression grammar over delimited text.

The grammar, in the order its alternatives are tried at each place of the text:

    item    <- quoted / bare
    quoted  <- '"' (!'"' . / '""')* '"' &after  /  "'" (!"'" . / "''")* "'" &after
    bare    <- (plain+ / bracket)+
    bracket <- '(' (![()] . / bracket)* ')'
    after   <- blank* (end / cut)

An alternative that fails gives back all it took, so a quote that never closes, or closes in
the middle of a value, is an ordinary cut and the text behind it is read again as bare values.
For brackets in at most two levels the grammar is compiled to one pattern whose repetitions are
possessive, as those of a parsing expression are: they run in a loop without recursion, so the
length of a text does not matter, and the work stays in the JVM. A pattern has no recursion for
more levels, so the few texts that have them are read by the same rules in an Arrow batch.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.protein import let


ITEMS = "array<struct<item:string,kind:string,item_error:string>>"


def grammar(blank_cuts: bool = False) -> str:
    """The pattern of one item. blank_cuts: blanks end a bare value too."""
    blank = "" if blank_cuts else " "
    plain = rf"\p{{L}}\p{{Nd}}.:%\-{blank}"
    # A closing quote counts if what follows, blanks aside, is a cut or the end.
    after = rf"(?=$|[^\p{{L}}\p{{Nd}}.:%\-(])" if blank_cuts else rf"(?= *+(?:$|[^{plain}(]))"
    double = rf'"[^"]*+(?:""[^"]*+)*+"{after}'
    single = rf"'[^']*+(?:''[^']*+)*+'{after}"
    bracket = r"\([^()]*+(?:\([^()]*+\)[^()]*+)*+\)"
    bare = rf"(?:[{plain}]++|{bracket})++"
    return f"{double}|{single}|{bare}"


def _clean(token: Column) -> Column:
    """The value of a token: outer quotes off, doubled quotes single, blanks trimmed."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.trim(
        F.when(token.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(token.startswith("'"), F.replace(inner, F.lit("''"), F.lit("'")))
        .otherwise(token)
    )


def _errors(rest: Column) -> Column:
    return F.concat_ws(",", F.when(rest.rlike("[\"']"), "quote"), F.when(rest.rlike("[()]"), "bracket"))


def items_of(text: str | Column, blank_cuts: bool = False) -> Column:
    """Array of (item, kind, item_error) in text order; empty values are gone. Null text: null. For brackets in at most two levels.

    item_error: what could not be taken before the value, or behind the last one.
    """
    text = F.col(text) if isinstance(text, str) else text
    pattern = grammar(blank_cuts)

    def made(tokens: Column, gaps: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            kind = F.when(t.rlike("^[\"']"), "quoted").when(t.contains("("), "bracketed").otherwise("bare")
            gap = F.concat(F.get(gaps, i), F.when(i == F.size(tokens) - 1, F.get(gaps, i + 1)).otherwise(""))
            return F.struct(_clean(t).alias("item"), kind.alias("kind"), _errors(gap).alias("item_error"))

        return F.transform(tokens, one)

    tokens = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Both arrays are made once, not once per token.
    return F.filter(let(tokens, lambda ts: let(F.split(text, pattern, -1), lambda gs: made(ts, gs))), lambda x: x["item"] != "")


def may_be_deep(text: Column) -> Column:
    """A bracket within a bracket and a third one: what texts with more than two levels have."""
    return (F.length(text) - F.length(F.replace(text, F.lit("("))) >= 3) & text.rlike(r"\([^()]*\(")


def error_of(text: str | Column, blank_cuts: bool = False) -> Column:
    """What no alternative could take: `quote`, `bracket`, `quote,bracket`, or '' for a well-formed text."""
    text = F.col(text) if isinstance(text, str) else text
    return _errors(F.regexp_replace(text, grammar(blank_cuts), ""))


def read(text: str, blank_cuts: bool = False) -> tuple[list[tuple[str, str, str]], str]:
    """The same items, and the error of the text, for brackets of any depth, in one pass."""
    plain = lambda c: c.isalpha() or c.isdecimal() or c in ".:%-" or (c == " " and not blank_cuts)
    close, open_ = {}, []
    for i, c in enumerate(text):
        if c == "(":
            open_.append(i)
        elif c == ")" and open_:
            close[open_.pop()] = i

    def quoted(i: int) -> int | None:
        q, j = text[i], i + 1
        while (j := text.find(q, j)) >= 0 and text[j + 1 : j + 2] == q:
            j += 2
        if j < 0:
            return None
        k = j + 1
        while not blank_cuts and text[k : k + 1] == " ":
            k += 1
        return j + 1 if k == len(text) or not (plain(text[k]) or text[k] == "(") else None

    def error(rest: str) -> str:
        return ",".join(name for name, marks in (("quote", "\"'"), ("bracket", "()")) if any(m in rest for m in marks))

    tokens, gaps, i, gap = [], [], 0, ""
    while i < len(text):
        end = quoted(i) if text[i] in "\"'" else None
        if end is None:
            end = i
            while end < len(text) and (plain(text[end]) or end in close):
                end = close.get(end, end) + 1
        if end == i:
            gap, i = gap + text[i], i + 1
            continue
        tokens.append(text[i:end])
        gaps.append(gap)
        gap, i = "", end
    out = []
    for n, (t, before) in enumerate(zip(tokens, gaps, strict=True)):
        q = t[0] if t[0] in "\"'" else ""
        item = (t[1:-1].replace(q + q, q) if q else t).strip(" ")
        if item:
            out.append((item, "quoted" if q else "bracketed" if "(" in t else "bare", error(before + (gap if n == len(tokens) - 1 else ""))))
    return out, error("".join(gaps) + gap)


def _deep(blank_cuts: bool):
    @F.pandas_udf(f"struct<items:{ITEMS},error:string>")
    def parsed(texts: pd.Series) -> pd.DataFrame:
        both = [read(t, blank_cuts) for t in texts]
        return pd.DataFrame({"items": [[dict(zip(("item", "kind", "item_error"), x, strict=True)) for x in items] for items, _ in both], "error": [e for _, e in both]})

    return parsed


def unpack(df: DataFrame, field: str, row_id: str, field_name: str, blank_cuts: bool = False, min_items: int = 1) -> DataFrame:
    """One row per packed value: field_name, row_id, item_pos (from 1), item, kind, error, item_error.

    Null, blank and delimiter-only texts give no row; repeated values keep their places; a text
    of any length and brackets of any depth are read whole; malformed quotes and brackets act as
    delimiters, set `error` on all rows of the text, and `item_error` on the value they stand
    before. Other columns of df, whatever their names, are not touched.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(field).cast("string").alias("_t")).where("_t is not null")
    flat = rows.where(~may_be_deep(F.col("_t"))).select("row_id", items_of("_t", blank_cuts).alias("_items"), error_of("_t", blank_cuts).alias("error"))
    deep = rows.where(may_be_deep(F.col("_t"))).select("row_id", _deep(blank_cuts)("_t").alias("_x")).select("row_id", F.col("_x.items").alias("_items"), F.col("_x.error").alias("error"))
    return (
        flat.unionByName(deep)
        .select("row_id", "error", F.posexplode(let(F.col("_items"), lambda x: F.when(F.size(x) >= min_items, x))).alias("_p", "_i"))
        .select(F.lit(field_name).alias("field_name"), "row_id", (F.col("_p") + 1).cast("int").alias("item_pos"), "_i.item", "_i.kind", "error", "_i.item_error")
    )
