"""Delimited lines: tokenising with per-column quotes, escapes and delimiters; export.

Where every special sequence is one character, a line is matched by one regular
expression and cut by one replacement, in generated code. Any other format goes
through an Arrow-batched function that follows the same rules.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans.model import ColumnFormat, DefinitionError, StreamFormat

SEPARATOR = "\x01"


def column_formats(f: StreamFormat) -> list[ColumnFormat]:
    """Every column's own settings over the format's; bad ones are an error."""
    out = []
    for name in f.fields:
        own = f.columns.get(name, ColumnFormat())
        c = ColumnFormat(
            own.quotes if own.quotes is not None else f.quotes, own.delimiters if own.delimiters is not None else (f.separator,),
            own.escapes if own.escapes is not None else ((f.escape,) if f.escape else ()), own.separators or (),
        )
        kinds: dict[str, str] = {}
        for kind, seqs in (("quote", {x for q in c.quotes for x in q}), ("delimiter", c.delimiters), ("escape", c.escapes), ("separator", c.separators)):
            for s in seqs:
                if not s or kinds.get(s, kind) != kind:
                    raise DefinitionError(f"column {name}: {s!r} has two meanings or none")
                kinds[s] = kind
        for a in kinds:
            if any(b != a and b.startswith(a) for b in kinds):
                raise DefinitionError(f"column {name}: {a!r} begins another special sequence")
        out.append(c)
    return out


class ParseError(ValueError):
    pass


def tokenize(line: str, formats: list[ColumnFormat]) -> list[list[tuple[str, str]]]:
    """(kind, text) tokens of every column: WORD, TOKENSEPARATOR, QUOTE, ESCAPE, DELIMITER."""
    columns: list[list[tuple[str, str]]] = []
    at = 0
    for i, c in enumerate(formats):
        tokens: list[tuple[str, str]] = []
        word, closing = "", None
        special = {x: "QUOTE" for q in c.quotes for x in q} | dict.fromkeys(c.delimiters, "DELIMITER") | dict.fromkeys(c.escapes, "ESCAPE") | dict.fromkeys(c.separators, "TOKENSEPARATOR")
        anyof = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        ended = False
        while not ended:
            hit = anyof.search(line, at) if anyof else None
            if hit is None:
                word += line[at:]
                at = len(line) + 1
                break
            word += line[at : hit.start()]
            text, kind = hit[0], special[hit[0]]
            at = hit.end()
            if kind == "ESCAPE":
                if word:
                    tokens.append(("WORD", word))
                tokens.append((kind, text))
                word = line[at : at + 1]
                at += 1
            elif closing is not None and kind != "QUOTE":
                word += text
            elif kind == "QUOTE":
                if closing is None:
                    closing = next((e for s, e in c.quotes if s == text), None)
                    if closing is None:
                        raise ParseError(f"{text!r} opens no quote")
                elif text == closing:
                    closing = None
                else:
                    raise ParseError(f"{text!r} does not end the quote")
                if word:
                    tokens.append(("WORD", word))
                    word = ""
                tokens.append((kind, text))
            else:
                if word:
                    tokens.append(("WORD", word))
                    word = ""
                tokens.append((kind, text))
                ended = kind == "DELIMITER"
        if word:
            tokens.append(("WORD", word))
        columns.append(tokens)
        if not ended:
            if i + 1 < len(formats):
                raise ParseError("too few columns")
            return columns
    raise ParseError("too many columns")


def values(line: str, formats: list[ColumnFormat]) -> list[str]:
    return ["".join(t for k, t in tokens if k in ("WORD", "TOKENSEPARATOR")) for tokens in tokenize(line, formats)]


def compiled(formats: list[ColumnFormat]) -> str | None:
    """One pattern for a line, a group for each column; None if a sequence is longer than a character."""
    every = [x for c in formats for x in (*c.delimiters, *c.escapes, *(y for q in c.quotes for y in q))]
    if any(len(x) > 1 for x in every) or any(c.separators for c in formats):
        return None
    groups = []
    for i, c in enumerate(formats):
        esc = "".join(map(re.escape, c.escapes))
        quotes = "".join({re.escape(y) for q in c.quotes for y in q})
        stop = "".join(map(re.escape, c.delimiters)) + quotes + esc
        units = [f"[{esc}](?:.|\\z)"] if esc else []
        for s, e in c.quotes:
            inner = f"[{esc}](?:.|\\z)|" if esc else ""
            units.append(f"{re.escape(s)}(?:{inner}[^{quotes}{esc}])*+(?:{re.escape(e)}|\\z)")
        units.append(f"[^{stop}]" if stop else ".")
        last = i + 1 == len(formats)
        groups.append(f"((?:{'|'.join(units)})*+)" + ("" if last else f"[{''.join(map(re.escape, c.delimiters))}]"))
    return r"(?s)\A" + "".join(groups) + r"\z"


def split_line(line: Column, f: StreamFormat) -> Column:
    """array<string> of the columns' values; null for a line that does not fit."""
    formats = column_formats(f)
    pattern = compiled(formats)
    if pattern is None:
        return python_split(line, formats)
    n = len(formats)
    joined = F.regexp_replace(line, pattern, SEPARATOR.join(f"${i + 1}" for i in range(n)))
    # a line that does not match stays as it is, and so is one part
    fits = (lambda parts: F.size(parts) == n) if n > 1 else (lambda parts: line.rlike(pattern))
    whole = lambda parts: F.when(fits(parts), F.array(*(plain(parts[i], c) for i, c in enumerate(formats))))
    # a line that holds the separating character itself is cut group by group
    groups = F.when(line.rlike(pattern), F.array(*(plain(F.regexp_extract(line, pattern, i + 1), c) for i, c in enumerate(formats))))
    return F.when(~line.contains(SEPARATOR), F.transform(F.array(F.split(joined, SEPARATOR, -1)), whole)[0]).otherwise(groups)


def plain(part: Column, c: ColumnFormat) -> Column:
    """A column's text without its quotes and escapes."""
    esc = "".join(map(re.escape, c.escapes))
    quotes = "".join({re.escape(y) for q in c.quotes for y in q})
    if not esc and not quotes:
        return part
    if not esc:
        return F.regexp_replace(part, f"[{quotes}]", "")
    return F.regexp_replace(part, f"(?s)[{esc}](.|\\z)" + (f"|[{quotes}]" if quotes else ""), "$1")


def python_split(line: Column, formats: list[ColumnFormat]) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return None if x is None else values(x, formats)
            except ParseError:
                return None

        return s.map(one)

    return run(line)


def parse_lines(df: DataFrame, f: StreamFormat) -> DataFrame:
    """df with received (struct of strings) and fine."""
    got = df.withColumn("_parts", split_line(F.col("line"), f))
    record = F.struct(*(F.col("_parts")[i].alias(name) for i, name in enumerate(f.fields)))
    return got.withColumn("fine", F.col("_parts").isNotNull()).withColumn("received", record)


def export_line(columns: list[Column], f: StreamFormat, escape: bool = False) -> Column:
    """Values joined by the separator, null as empty. Special sequences inside
    values are left alone unless escape is set."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    if escape:
        special = "|".join(map(re.escape, {f.separator, f.escape, *(y for q in f.quotes for y in q)} - {""}))
        parts = [F.regexp_replace(p, f"({special})", f.escape.replace("\\", "\\\\").replace("$", "\\$") + "$1") for p in parts]
    return F.concat_ws(f.separator, *parts)
