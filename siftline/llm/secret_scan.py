"""Secret scans with one combined deterministic automaton.

The heads of all rules are compiled on the driver into a single minimised
transition array (about 200 states, whatever the data) and each executor reads
every text once, byte by byte, for all rules together; where a head was found,
its rule is read on by an array of its own, in time linear in the text.  ``\\b``
is the plain word boundary, so words begin after hyphens too ("--password=...").
A private key is taken to its END line; without one, its BEGIN line is.

Cases: null and empty texts have no secrets; texts of any length are scanned
whole; rows with a null id are scanned too and reported with a null id;
repeated rows are reported once each; other columns are ignored (``secrets``)
or kept (``without_secrets``); an empty table gives no rows.  Matches of one
rule never overlap (leftmost, then longest); those of different rules may.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.automaton import Rule, Scanner, compile_rules

RULES = [
    Rule("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    Rule("github_token", r"\bgh[pousr]_[0-9A-Za-z]{36}\b"),
    Rule("slack_token", r"\bxox[abprs]-[0-9A-Za-z\-]{10,}\b"),
    Rule("google_api_key", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    Rule("stripe_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b"),
    Rule("json_web_token", r"\beyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}\b"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----(?:(?:-?[^\-])*-----END (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----)?"),
    Rule("quoted_token", r"\b(?:token|secret|api_key|apikey|access_key|auth) ?[=:] ?\"[0-9A-Za-z_\-]{16,}\""),
    Rule("password", r"\b(?:password|passwd|pwd) ?[=:] ?[0-9A-Za-z!@#$%&*_\-]{8,}\b"),
]

_SCHEMA = "doc_id long, rule string, start long, stop long, secret string"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """``(doc_id, rule, start, stop, secret)``; ``start`` and ``stop`` count bytes."""
    scanner = compile_rules(rules or RULES)
    names = [r.name for r in scanner.rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, text in enumerate(batch.column(1)):
                value = text.as_py()
                for rule, start, stop in scanner.scan(data := value.encode()) if value else ():
                    rows.append((n, names[rule], start, stop, data[start:stop].decode(errors="replace")))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], ["doc_id", "rule", "start", "stop", "secret"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(scan, _SCHEMA)


def redact(scanner: Scanner, text: str) -> str:
    """``text`` with ``[SECRET:rule]`` in place of its secrets; of overlapping ones the first, then the longest."""
    data = text.encode()
    found = sorted(((start, -stop, rule) for rule, start, stop in scanner.scan(data)))
    if not found:
        return text
    parts, at = [], 0
    for start, stop, rule in found:
        stop = -stop
        if start >= at:
            parts += [data[at:start], f"[SECRET:{scanner.rules[rule].name}]".encode()]
        elif stop > at:
            pass  # the rest of a secret that begins inside another goes with it
        else:
            continue
        at = stop
    return b"".join([*parts, data[at:]]).decode(errors="replace")


def without_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` with every secret replaced, ``chars_col`` (where there is one) counted anew for changed texts.

    All rows and columns stay in their order; null texts stay null.
    """
    scanner = compile_rules(rules or RULES)
    names, schema = docs.columns, docs.schema
    at = names.index(text_col)
    chars = names.index(chars_col) if chars_col in names and isinstance(schema[chars_col].dataType, T.IntegralType) else -1

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            texts = batch.column(at)
            for n, text in enumerate(texts):
                value = text.as_py()
                if value and (new := redact(scanner, value)) != value:
                    changed[n] = new
            if changed:
                cols = list(batch.columns)
                cols[at] = pa.array([changed.get(n, t.as_py()) for n, t in enumerate(texts)], texts.type)
                if chars >= 0:
                    cols[chars] = pa.array([len(changed[n]) if n in changed else v.as_py() for n, v in enumerate(cols[chars])], cols[chars].type)
                batch = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, schema)


def oracle_sql(rules: list[Rule] | None = None) -> str:
    """DuckDB SQL for ``secrets`` over ``documents``: the texts between the matches give the places."""
    parts = []
    for rule in rules or RULES:
        p = rule.pattern.replace("'", "''")
        parts.append(f"SELECT doc_id, '{rule.name}' AS rule, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM documents")
    return (
        "WITH found AS (" + " UNION ALL ".join(parts) + "), each AS (SELECT doc_id, rule, gaps, hits, unnest(range(1, len(hits) + 1)) AS k"
        " FROM found WHERE len(hits) > 0), placed AS (SELECT doc_id, rule, hits[k] AS secret,"
        " list_sum(list_transform(gaps[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: strlen(x))), 0) AS start"
        " FROM each) SELECT doc_id, rule, CAST(start AS BIGINT) AS start, CAST(start + strlen(secret) AS BIGINT) AS stop, secret FROM placed"
    )
