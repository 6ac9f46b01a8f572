"""Keyword and rule scans over an ordered stream of chunks.

Keywords are case-sensitive bytes, as UTF-8 or UTF-16LE, found left to right without overlap in each window. A window is
a chunk and the first bytes of the next, so that a hit across a border is found once, in the chunk of its first byte.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of context on either side of a hit.
CONTEXT = 32
#: Bytes of a text that a border window looks into.
BORDER = 256


def windows(chunks: DataFrame, border: int = BORDER) -> DataFrame:
    """chunks (sequence, source_offset, content) with the next chunk's first and the one before's last bytes."""
    nxt = chunks.select((F.col("sequence") - 1).alias("sequence"), F.substring("content", 1, border).alias("tail"))
    before = chunks.select((F.col("sequence") + 1).alias("sequence"), F.expr(f"substring(content, -{CONTEXT}, {CONTEXT})").alias("head"))
    none = F.lit(b"").cast("binary")
    return chunks.join(nxt, "sequence", "left").join(before, "sequence", "left").withColumns({"tail": F.coalesce("tail", none), "head": F.coalesce("head", none)})


def keyword_hits(chunks: DataFrame, keywords: list[str], encodings: tuple[str, ...] = ("utf-8", "utf-16le")) -> DataFrame:
    """(keyword, encoding, sequence, physical_offset, context_before, context_after) of all hits."""
    needles = [(k, e, k.encode(e)) for k in keywords for e in encodings]
    border = max(len(n) for _, _, n in needles) - 1 + CONTEXT

    def run(batches):
        for pdf in batches:
            rows = []
            for seq, off, content, tail, head in zip(pdf["sequence"], pdf["source_offset"], pdf["content"], pdf["tail"], pdf["head"]):
                content, head = bytes(content), bytes(head)
                data = head + content + bytes(tail)
                for k, e, needle in needles:
                    at = data.find(needle, len(head))
                    while 0 <= at < len(head) + len(content):
                        end = at + len(needle)
                        rows.append((k, e, seq, int(off) + at - len(head), data[max(0, at - CONTEXT) : at].hex(), data[end : end + CONTEXT].hex()))
                        at = data.find(needle, end)
            yield pd.DataFrame(rows, columns=["keyword", "encoding", "sequence", "physical_offset", "context_before", "context_after"])

    cols = ["sequence", "source_offset", "content", "tail", "head"]
    return windows(chunks, border).select(*cols).mapInPandas(run, "keyword string, encoding string, sequence long, physical_offset long, context_before string, context_after string")


def keyword_offsets(texts: DataFrame, keyword: str) -> DataFrame:
    """(id, byte_offset) of a keyword in texts (id, text), non-overlapping, in the JVM: pieces between hits and running sums of their bytes."""
    parts = F.split("text", re.escape(keyword), -1)
    size = len(keyword.encode())
    step = F.transform(parts, lambda p: F.octet_length(p) + size)
    upto = F.transform(F.sequence(F.lit(1), F.size(step) - 1), lambda k: F.aggregate(F.slice(step, 1, k), F.lit(0), lambda a, x: a + x) - size)
    return texts.where(F.col("text").contains(keyword)).select("id", F.explode(F.when(F.size(step) > 1, upto)).alias("byte_offset"))


@dataclass
class Rule:
    """A compiled rule: name, named patterns (kind, body) and a condition."""

    name: str
    strings: dict[str, tuple[str, str]] = field(default_factory=dict)
    condition: str = "any"


_RULE = re.compile(r"rule\s+(\w+)[^{]*\{(.*?)\n\}", re.S)
_STRING = re.compile(r"^\s*(\$\w*)\s*=\s*(\"(?:[^\"\\]|\\.)*\"|/(?:[^/\\]|\\.)+/|\{[^}]*\})\s*((?:nocase|ascii|wide)?(?:\s+(?:nocase|ascii|wide))*)\s*$", re.M)


def compile_rules(text: str) -> list[Rule]:
    """Rules of a subset: text (nocase), hexadecimal and regular-expression strings; any, all, `$a and $b`, `$a or $b`, true."""
    out = []
    for name, body in _RULE.findall(text.lstrip("﻿")):
        r = Rule(name)
        for key, value, mods in _STRING.findall(body):
            if value[0] == '"':
                plain = re.escape(value[1:-1].replace('\\"', '"').replace("\\\\", "\\"))
                r.strings[key] = ("regex", ("(?i)" if "nocase" in mods else "") + plain)
            elif value[0] == "/":
                r.strings[key] = ("regex", ("(?i)" if "nocase" in mods else "") + value[1:-1])
            else:
                pairs = value[1:-1].split()
                r.strings[key] = ("hex", "".join("." if p == "??" else "\\x" + p for p in pairs))
        cond = re.search(r"condition:\s*(.*)$", body, re.S)
        r.condition = " ".join((cond.group(1) if cond else "any of them").split())
        out.append(r)
    return out


def matches(rule: Rule, content: Column) -> Column:
    """Whether a rule's condition holds for a text column; bytes are read as ISO-8859-1, one character a byte."""
    found = {k: content.rlike(p if kind == "regex" else "(?s)" + p) for k, (kind, p) in rule.strings.items()}
    cond = rule.condition
    if cond == "true":
        return F.lit(True)
    if cond in ("any of them", "any"):
        out = F.lit(False)
        for c in found.values():
            out = out | c
        return out
    if cond == "all of them":
        out = F.lit(True)
        for c in found.values():
            out = out & c
        return out
    out = F.lit(False)
    for alternative in cond.split(" or "):
        both = F.lit(True)
        for name in alternative.split(" and "):
            both = both & found[name.strip(" ()")]
        out = out | both
    return out


def rule_hits(chunks: DataFrame, rules: list[Rule], ruleset_hash: str) -> DataFrame:
    """(rule_name, ruleset_hash, sequence, pattern, physical_offset, match_length) of chunks (sequence, source_offset, content)."""
    text = F.decode("content", "ISO-8859-1")
    met = chunks.withColumn("hit", F.filter(F.array(*[F.when(matches(r, text), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())).where(F.size("hit") > 0)
    compiled = {r.name: {k: re.compile(p.encode("latin-1"), re.S) for k, (_, p) in r.strings.items()} for r in rules}

    def run(batches):
        for pdf in batches:
            rows = []
            for seq, off, content, names in zip(pdf["sequence"], pdf["source_offset"], pdf["content"], pdf["hit"]):
                for n in np.asarray(names).tolist():
                    spans = [(k, m.start(), m.end()) for k, p in compiled[n].items() for m in p.finditer(bytes(content))] or [("", 0, 0)]
                    rows += [(n, ruleset_hash, seq, k, int(off) + a, b - a) for k, a, b in spans]
            yield pd.DataFrame(rows, columns=["rule_name", "ruleset_hash", "sequence", "pattern", "physical_offset", "match_length"])

    return met.select("sequence", "source_offset", "content", "hit").mapInPandas(run, "rule_name string, ruleset_hash string, sequence long, pattern string, physical_offset long, match_length long")
