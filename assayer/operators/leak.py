"""Corpus leak scan: which documents name unpublished ids, carry protected fields or quote
held-out passages. A finding is (doc, rule, detail).

Ids are found by pattern and compared with a positive allowlist, so nothing private has to be
listed. Documents are always scanned whole.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.session import cut_lineage

# Shape of an id, protected fields, path and name patterns, scanned suffixes.
ID_PATTERN = r"\bCB_(?:T\d|DEEP|MULTI)[A-Z0-9_]*\b"
FIELD_PATTERN = r'"(answer_sha256|gold_answer|gold_sql)"\s*:'
PATH_PARTS = (
    "gold_answers",
    "input_tasks",
    "compiled_201_review",
    "compiled_v1_2",
    "projection_review",
    "public_split",
    "answer_key",
)
NAME_PATTERN = (
    r"(?i)(questions_answers|answer[_-]?key|_submission\.json$|task_scores\.json$"
    r"|compile_manifest\.json$)"
)
TEXT_SUFFIXES = (
    ".md", ".json", ".jsonl", ".py", ".txt", ".yml", ".yaml", ".csv", ".html", ".sh", ".cff", ".sql",
)


def expand_allowlist(ids: DataFrame) -> DataFrame:
    """Published task ids with their session id and turn id; exact strings, never prefixes."""
    turn = F.regexp_extract("id", r"^(.*)_T(\d+)$", 2)
    with_turn = ids.select("id", turn.alias("turn")).where("turn <> ''")
    session = with_turn.select(F.regexp_extract("id", r"^(.*)_T(\d+)$", 1).alias("id"))
    turns = with_turn.select(F.concat_ws("_T", "id", "turn").alias("id"))
    return ids.select("id").unionByName(session).unionByName(turns).distinct()


def extract_ids(docs: DataFrame, pattern: str = ID_PATTERN) -> DataFrame:
    """Distinct (doc, id). Repeats inside one text are dropped before the shuffle."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return docs.select("doc", F.explode(found).alias("id")).distinct()


def first_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k smallest distinct values per key and how many there are.

    The values are numbered by a range sort instead of being gathered, so a key may hold any
    number of them.
    """
    from assayer.operators.ordering import numbered

    values = df.select(key, value).distinct()
    total = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    first = numbered(values, [key], [value], into="_i").where(F.col("_i") <= k)
    shown = F.transform(
        F.sort_array(F.collect_list(F.struct("_i", value))), lambda s: s[value]
    )
    return first.groupBy(key).agg(shown.alias("shown")).join(total, key)


def unknown_ids(docs: DataFrame, allowlist: DataFrame, k: int = 5) -> DataFrame:
    """Ids outside the allowlist per document: how many, and the first k in order."""
    unknown = extract_ids(docs).join(allowlist.select("id"), "id", "left_anti")
    out = first_k(unknown, "doc", "id", k)
    more = F.when(F.col("n") > k, " …").otherwise("")
    return out.select(
        "doc",
        "n",
        F.concat(F.array_join("shown", ", "), more).alias("shown"),
    )


def forbidden_path(files: DataFrame, parts: Sequence[str] = PATH_PARTS) -> DataFrame:
    """One finding per forbidden fragment of the path."""
    hits = F.filter(F.array(*[F.lit(p) for p in parts]), lambda p: F.col("doc").contains(p))
    return files.select("doc", F.explode(hits).alias("detail"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def forbidden_name(files: DataFrame, exempt: Sequence[str] = (), pattern: str = NAME_PATTERN) -> DataFrame:
    found = files.where(file_name(F.col("doc")).rlike(pattern))
    return found.where(~F.col("doc").isin(*exempt)) if exempt else found


def sensitive_field(docs: DataFrame, exempt: Sequence[str] = (), pattern: str = FIELD_PATTERN) -> DataFrame:
    """First protected field a document carries."""
    field = F.regexp_extract("text", pattern, 1)
    found = docs.select("doc", field.alias("detail")).where("detail <> ''")
    return found.where(~F.col("doc").isin(*exempt)) if exempt else found


def glob_regex(pattern: str) -> str:
    """Shell pattern as a whole-text regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """A folder pattern ends in '/'; any other one is matched against the path and the name."""
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            hit = hit | path.startswith(p) | F.concat(F.lit("/"), path).contains(f"/{p}")
        else:
            hit = hit | path.rlike(glob_regex(p)) | file_name(path).rlike(glob_regex(p))
    return hit


def scan(
    files: DataFrame,
    published: DataFrame,
    ignore: Sequence[str] = (),
    exempt: Sequence[str] = (),
    bearing: Sequence[str] = (),
    suffixes: Sequence[str] = TEXT_SUFFIXES,
) -> DataFrame:
    """All findings of a file tree (doc, text): paths, names, fields, ids and a missing allowlist."""
    kept = files.where(~ignored(F.col("doc"), ignore))
    suffix = F.lower(F.regexp_extract(file_name(F.col("doc")), r"(?:.)(\.[^.]+)$", 1))
    text = kept.where(suffix.isin(*suffixes))
    rule = lambda df, name: df.select("doc", F.lit(name).alias("rule"), "detail")
    allow = expand_allowlist(published)
    unknown = unknown_ids(text, allow)
    detail = F.concat(F.col("n").cast("string"), F.lit(" unknown: "), "shown")
    empty = allow.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    return (
        rule(forbidden_path(kept), "forbidden_path")
        .unionByName(
            rule(forbidden_name(kept, exempt).withColumn("detail", file_name(F.col("doc"))), "forbidden_name")
        )
        .unionByName(rule(sensitive_field(text, [*exempt, *bearing]), "sensitive_field"))
        .unionByName(rule(unknown.withColumn("detail", detail), "unknown_ids"))
        .unionByName(
            rule(
                empty.select(F.lit(None).cast("string").alias("doc"), F.lit("no ids").alias("detail")),
                "allowlist_required",
            )
        )
    )


def skipped(files: DataFrame, ignore: Sequence[str]) -> DataFrame:
    """How many files the ignore patterns set aside; always reported."""
    hit = ignored(F.col("doc"), ignore)
    return files.agg(
        F.count_if(~hit).alias("scanned"), F.count_if(hit).alias("skipped")
    )


# ---------------------------------------------------------------- verbatim passages

GRAM = 6  # tokens of an anchor; longer anchors are rarer


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _grams(tokens: str, n: int) -> Column:
    return F.expr(
        f"transform(sequence(0, size({tokens}) - {n}), i -> xxhash64(slice({tokens}, i + 1, {n})))"
    )


def verbatim_passages(docs: DataFrame, passages: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc, item) pairs whose document text contains the passage character by character.

    A passage found in a text brings all its inner tokens along as whole tokens (only its first
    and last token may be cut from longer ones). Its anchor is one run of inner tokens: among its
    runs the one that fewest documents hold, so that boilerplate is not used when anything rarer
    is there. Documents meet passages by anchor hash only, and ``contains`` settles each
    candidate on the whole texts.

    The anchors join the exploded hashes: Catalyst broadcasts them while they are small and
    shuffles both sides by hash when they are not. Passages with too few inner tokens for a run
    meet by character runs in the same way.
    """
    items = passages.where(F.length("text") > 0).select(
        "item", F.col("text").alias("passage"), _tokens(F.col("text")).alias("t")
    )
    inner = items.withColumn("inner", F.expr("slice(t, 2, greatest(size(t) - 2, 0))"))
    long = inner.where(F.size("inner") >= gram).select(
        "item", F.explode(F.array_distinct(_grams("inner", gram))).alias("h")
    )
    texts = docs.select("doc", _tokens(F.col("text")).alias("t")).where(F.size("t") >= gram)
    words = texts.select("doc", F.explode(F.array_distinct(_grams("t", gram))).alias("h"))
    pairs = _by_rarest(words, long)

    short = inner.where(F.size("inner") < gram)
    q = short.agg(F.min(F.length("passage"))).first()[0]
    if q is not None:
        q = min(q, 24)
        cut = lambda c: F.expr(
            f"transform(sequence(1, length({c}) - {q} + 1), i -> xxhash64(substring({c}, i, {q})))"
        )
        runs = short.select("item", F.explode(F.array_distinct(cut("passage"))).alias("h"))
        letters = docs.where(F.length("text") >= q).select(
            "doc", F.explode(F.array_distinct(cut("text"))).alias("h")
        )
        pairs = pairs.unionByName(_by_rarest(letters, runs))

    found = (
        docs.join(pairs, "doc")
        .join(items.select("item", "passage"), "item")
        .where(F.col("text").contains(F.col("passage")))
    )
    return found.select("doc", "item")


def _by_rarest(doc_hashes: DataFrame, item_hashes: DataFrame) -> DataFrame:
    """Candidate (doc, item) by the item hash that fewest documents hold.

    The texts are hashed once: the (document, hash) hits on any passage are written, and both the
    document counts and the candidates come from them.
    """
    wanted = item_hashes.select("h").distinct()
    hits = cut_lineage(doc_hashes.join(wanted, "h", "left_semi"))
    counted = hits.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    # a hash no document holds proves that its passage is nowhere
    anchors = (
        item_hashes.join(counted, "h", "left")
        .groupBy("item")
        .agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "h")).alias("a"))
        .where("a.docs > 0")
        .select("item", F.col("a.h").alias("h"))
    )
    return hits.join(anchors, "h").select("doc", "item").distinct()
