"""Result-set comparison over long frames: one row per answer row, any number of answers at once.

Frames
------
``gold``   task_id, row_pos, cells                    one row per gold answer row
``pred``   run_id, task_id, row_pos, cells            one row per predicted answer row

An answer is never gathered into one array, so the size of a single answer does not matter:
rows meet by (task, signature) or (task, position), which spreads evenly.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators.ordering import running_sum
from assayer.session import cut_lineage


def answer_rows(
    df: DataFrame, keys: list[str], columns: list[str] | None = None, order: str | None = None
) -> DataFrame:
    """Turn a typed result frame into answer rows; ``keys`` say which answer a row belongs to.

    The prepared cells come along: typed columns are parsed by generated code.
    """
    columns = columns or [c for c in df.columns if c not in keys and c != order]
    df, cells, prepared = C.prepared_columns(df, columns)
    pos = F.col(order).cast("long") if order else F.lit(None).cast("long")
    return df.select(*keys, pos.alias("row_pos"), cells.alias("cells"), prepared.alias("prep"))


def signed(rows: DataFrame) -> DataFrame:
    """Add the prepared cells, unless they are there, and the name-free signature of every row."""
    if "prep" not in rows.columns:
        rows = rows.withColumn("prep", C.prepare(F.col("cells")))
    return rows.withColumn("sig", C.row_signature(F.col("prep")))


def rates(df: DataFrame, tp: Column, n_pred: Column, n_gold: Column) -> DataFrame:
    """precision, recall and row_f1; two empty sides agree, one empty side scores 0."""
    precision = F.when(n_pred > 0, tp / n_pred).otherwise(F.when(n_gold == 0, 1.0).otherwise(0.0))
    recall = F.when(n_gold > 0, tp / n_gold).otherwise(F.when(n_pred == 0, 1.0).otherwise(0.0))
    df = df.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return df.withColumn("row_f1", f1)


def set_counts(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct signatures per (run, task): on both sides, predicted, gold.

    One shuffle by (task, signature) serves every run; the runs of a signature are a small array.
    """
    side = gold.select(
        "task_id", "sig", F.lit(True).alias("is_gold"), F.lit(None).cast("string").alias("run_id")
    ).unionByName(
        pred.select("task_id", "sig", F.lit(False).alias("is_gold"), F.col("run_id").cast("string"))
    )
    met = side.groupBy("task_id", "sig").agg(
        F.max("is_gold").alias("in_gold"), F.collect_set("run_id").alias("runs")
    )
    gold_n = met.where("in_gold").groupBy("task_id").agg(F.count(F.lit(1)).alias("gold_distinct"))
    per_run = (
        met.select("task_id", "in_gold", F.explode("runs").alias("run_id"))
        .groupBy("run_id", "task_id")
        .agg(F.count(F.lit(1)).alias("pred_distinct"), F.count_if("in_gold").alias("tp"))
    )
    zero = F.lit(0).cast("long")
    return (
        pairs.join(gold_n, "task_id", "left")
        .join(per_run, ["run_id", "task_id"], "left")
        .select(
            *pairs.columns,
            *[F.coalesce(c, zero).alias(c) for c in ("gold_distinct", "pred_distinct", "tp")],
        )
    )


def set_match(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Set comparison on distinct signatures: copies of a row count once."""
    counts = set_counts(gold, pred, pairs)
    exact = (F.col("tp") == F.col("gold_distinct")) & (F.col("tp") == F.col("pred_distinct"))
    return rates(counts, F.col("tp"), F.col("pred_distinct"), F.col("gold_distinct")).withColumn(
        "exact", exact
    )


def multiset_match(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Comparison that keeps how often each row occurs."""
    g = gold.groupBy("task_id", "sig").agg(F.count(F.lit(1)).alias("g"))
    p = pred.groupBy("run_id", "task_id", "sig").agg(F.count(F.lit(1)).alias("p"))
    gold_n = g.groupBy("task_id").agg(F.sum("g").alias("gold_rows"))
    hit = (
        p.join(g, ["task_id", "sig"], "left")
        .groupBy("run_id", "task_id")
        .agg(
            F.sum("p").alias("pred_rows"),
            F.sum(F.least(F.col("p"), F.coalesce("g", F.lit(0)))).alias("tp"),
        )
    )
    zero = F.lit(0).cast("long")
    out = (
        pairs.join(gold_n, "task_id", "left")
        .join(hit, ["run_id", "task_id"], "left")
        .select(
            *pairs.columns,
            *[F.coalesce(c, zero).alias(c) for c in ("gold_rows", "pred_rows", "tp")],
        )
    )
    exact = (F.col("tp") == F.col("gold_rows")) & (F.col("tp") == F.col("pred_rows"))
    return rates(out, F.col("tp"), F.col("pred_rows"), F.col("gold_rows")).withColumn(
        "exact", exact
    )


def ordered_hits(gold: DataFrame, pred: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Rows equal at the same position per (run, task); ``tolerance``: task_id, abs_tol, rel_tol."""
    met = pred.select("run_id", "task_id", "row_pos", F.col("prep").alias("p")).join(
        gold.select("task_id", "row_pos", F.col("prep").alias("g")), ["task_id", "row_pos"]
    )
    same = C.rows_equal(F.col("g"), F.col("p"), F.col("abs_tol"), F.col("rel_tol"))
    return (
        met.join(tolerance.select("task_id", "abs_tol", "rel_tol"), "task_id")
        .select("run_id", "task_id", same.alias("same"))
        .groupBy("run_id", "task_id")
        .agg(F.count_if("same").alias("in_place"))
    )


# ---------------------------------------------------------------- tolerant one-to-one matching


def _part(prep: Column) -> Column:
    """What equal rows share: width, number of nulls and the texts that equal only themselves."""
    fixed = F.filter(prep, lambda c: (c["kind"] == "other") | ((c["kind"] == "str") & c["dbl"].isNull()))
    nulls = F.filter(prep, lambda c: c["kind"] == "null")
    shared = F.struct(F.size(prep).alias("w"), F.size(nulls).alias("n"), F.array_sort(F.transform(fixed, lambda c: c["low"])).alias("t"))
    return F.coalesce(F.to_json(shared), F.lit(""))  # never null, so that no join works it out twice to see that


def _numbers(prep: Column) -> Column:
    """The numbers of a row with the places they carry, booleans as 0 and 1 without places."""
    number = lambda c: F.when(c["kind"] == "bool", (c["text"] == "true").cast("double")).otherwise(c["dbl"])
    bounded = lambda v: F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1e300)), F.lit(-1e300)))
    places = lambda c: F.when(c["kind"] != "bool", F.coalesce(c["places"], F.lit(0)))
    numbers = F.transform(prep, lambda c: F.struct(bounded(number(c)).alias("v"), places(c).alias("places")))
    return F.filter(numbers, lambda c: c["v"].isNotNull())


def _peak(prep: Column) -> Column:
    """The largest number of a row."""
    return F.coalesce(F.array_max(F.transform(_numbers(prep), lambda c: c["v"])), F.lit(0.0))


def _reach(prep: Column, peak: Column, abs_tol: Column, rel_tol: Column) -> Column:
    """How far the largest number of an equal row can be from ``peak``, that of the gold row ``prep``.

    Each number has its own reach: one half of its last place and the tolerance. So the largest number
    lies between the largest lower end and the largest upper end.
    """
    share = F.when(rel_tol < 0.5, rel_tol / (1 - rel_tol)).otherwise(F.lit(1e300))  # of the larger of both numbers

    def ends(c: Column) -> Column:
        # a little more than one half, since the last place of a double is not exact
        rounding = F.coalesce(0.51 * F.pow(F.lit(10.0), -c["places"]), F.lit(0.0)) + F.abs(c["v"]) * 1e-15
        r = F.least(abs_tol + share * (F.abs(c["v"]) + 1) + rounding, F.lit(1e305))
        return F.struct((c["v"] - r).alias("low"), (c["v"] + r).alias("high"))

    found = F.transform(_numbers(prep), ends)
    low, high = F.array_max(F.transform(found, lambda e: e["low"])), F.array_max(F.transform(found, lambda e: e["high"]))
    return F.coalesce(F.greatest(high - peak, peak - low, F.lit(1e-300)), F.lit(1.0))


def _classes(rows: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Rows of equal signature as one, with their number and first position.

    Rows of equal cells are counted first, by texts and places: hashing takes one look at a row, while a group that carries
    prepared cells is sorted. Cells are prepared, and signatures written, once per distinct row.
    """
    if "prep" in rows.columns:
        rows, by = rows.select(*keys, "row_pos", "cells", F.col("prep")["places"].alias("places")), ["cells", "places"]
        prep = C.prepare_again(F.col("cells"), F.col("places"))
    else:
        by, prep = ["cells"], C.prepare(F.col("cells"))
    same = rows.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("n"), F.min("row_pos").alias("first")).withColumn("prep", prep)
    one = same.withColumn("sig", C.row_signature(F.col("prep"))).groupBy(*keys, "sig").agg(
        F.sum("n").alias(f"{side}_left"), F.min("first").alias("first"), F.first("prep").alias("prep")
    )
    return one.select(*keys, "sig", f"{side}_left", "first", "prep", _part(F.col("prep")).alias("part"), _peak(F.col("prep")).alias("peak"))


#: So many pairs at most are sent to every executor, so that rows need not move to meet them.
FEW = 50_000


def tolerant_edges(gold: DataFrame, pred: DataFrame, pairs: DataFrame, keep: bool = False) -> DataFrame:
    """(run, task, g, g_left, p, p_left): classes of rows that are equal within the tolerance.

    Equal rows lie in the same part, and their largest numbers differ by no more than the gold row's ``reach``, which
    follows from the places of all its numbers (``_reach``). So rows meet in cells of width ``10 ** scale``, a gold row in
    three of them, no answer is compared all with all, and only rows within reach are compared cell by cell. With ``keep``
    the gold classes are written, so that gold rows are read once.
    """
    key = ["run_id", "task_id"]
    want = pairs.select(*key, "abs_tol", "rel_tol", "in_order")
    if want.limit(FEW + 1).count() <= FEW:
        want, tasks, answers = F.broadcast(want), F.broadcast(want.select("task_id").distinct()), F.broadcast(want.select(*key))
    else:
        tasks, answers = want.select("task_id").distinct(), want.select(*key)
    place = lambda side: F.struct(F.when(F.col("in_order"), F.col("first")).alias("pos"), F.col("sig")).alias(side)
    value = F.col("peak")
    g = _classes(gold.join(tasks, "task_id", "left_semi"), ["task_id"], "g")
    g = (cut_lineage(g) if keep else g).join(want, "task_id")
    g = g.withColumn("reach", _reach(F.col("prep"), value, F.col("abs_tol"), F.col("rel_tol")))
    g = g.withColumn("scale", F.coalesce(F.ceil(F.log10(1.25 * F.col("reach"))).cast("int"), F.lit(0)))
    cell = F.floor(value / F.pow(F.lit(10.0), F.col("scale").cast("double")))
    g = g.select(
        *key, "part", "scale", place("g"), "g_left", F.col("prep").alias("gp"), value.alias("gv"), "reach", "abs_tol", "rel_tol",
        F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"),
    )
    p = _classes(pred.join(answers, key, "left_semi"), key, "p").join(want.select(*key, "in_order"), key)
    scales = g.select(*key, "part", "scale").distinct()
    p = p.join(scales, [*key, "part"]).select(*key, "part", "scale", place("p"), "p_left", F.col("prep").alias("pp"), value.alias("pv"), cell.alias("cell"))
    near = F.abs(F.col("gv") - F.col("pv")) <= F.col("reach")
    tolerance = F.col("abs_tol"), F.col("rel_tol")
    single = C.values_equal(F.get("gp", F.lit(0)), F.get("pp", F.lit(0)), *tolerance)  # as generated code, unlike whole rows
    same = F.when((F.size("gp") == 1) & (F.size("pp") == 1), single).otherwise(C.rows_equal(F.col("gp"), F.col("pp"), *tolerance))
    return g.join(p, [*key, "part", "scale", "cell"]).where(near & same).select(*key, "g", "g_left", "p", "p_left")


#: Edges of an answer up to which what is left of it is matched in one task.
SEQUENTIAL = 200_000


def greedy_assignment(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """``matched`` rows per (run, task) for ``pairs`` (run_id, task_id, gold_rows, pred_rows, abs_tol,
    rel_tol, in_order): distinct gold rows in order of position or signature, each taking
    the first predicted rows that fit and are left, as many as it has copies.

    Gold classes that share no partner are done at once (``_alone``). Any other gets a stretch of predicted rows at
    a time (``_stretches``), so its number of copies and partners does not matter. What two such steps leave are gold classes that compete for the same rows; these are
    matched one after the other, an answer in one task (``_in_sequence``). Only answers with more than ``SEQUENTIAL`` edges
    left go on with stretches; there the first gold class that is left and all that do not compete with one before
    them end with every step.
    """
    key = ["run_id", "task_id"]
    pairs = cut_lineage(pairs)  # read several times
    alone, edges = _alone(cut_lineage(tolerant_edges(gold, pred, pairs, keep=True)))
    taken, step = [alone], 0
    while not edges.isEmpty():
        if step >= 2:
            big = edges.groupBy(*key).count().where(F.col("count") > SEQUENTIAL)
            taken.append(cut_lineage(_in_sequence(edges.join(big, key, "left_anti"))))
            edges = cut_lineage(edges.join(big, key, "left_semi"))
            if edges.isEmpty():
                break
        moved, edges = _stretches(edges)
        taken.append(moved)
        step += 1
    none = F.lit(0).cast("long")
    found = reduce(DataFrame.unionByName, taken).groupBy(*key).agg(F.sum("moved").alias("matched"))
    return pairs.select(*key).join(found, key, "left").select(*key, F.coalesce("matched", none).alias("matched"))


def _alone(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What gold classes take of which no partner fits another one (run_id, task_id, moved), and the edges of all others.

    Nothing else can take their partners, so the order does not matter and a sum tells what they take.
    """
    key = ["run_id", "task_id"]
    shared = edges.groupBy(*key, "p").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, "p")
    rivals = cut_lineage(edges.join(shared, [*key, "p"], "left_semi").select(*key, "g").distinct())
    sums = edges.join(rivals, [*key, "g"], "left_anti").groupBy(*key, "g", "g_left").agg(F.sum("p_left").alias("p_left"))
    moved = sums.select(*key, F.least("g_left", "p_left").alias("moved"))
    return cut_lineage(moved), cut_lineage(edges.join(rivals, [*key, "g"], "left_semi"))


def _stretches(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step: what every gold class takes (run_id, task_id, moved), and the edges that are left.

    The partners of a gold class up to the first that an earlier gold class may take are its own: it takes
    them in their order until its copies are used up, which the running sum of theirs tells.
    """
    key = ["run_id", "task_id"]
    first = edges.groupBy(*key, "p").agg(F.min("g").alias("first"))
    met = edges.join(first, [*key, "p"])
    stop = met.where("g <> first").groupBy(*key, "g").agg(F.min("p").alias("stop"))
    own = met.where("g = first").join(stop, [*key, "g"], "left").where("stop is null or p < stop")
    partners = own.groupBy(*key, "g").agg(F.count(F.lit(1)).alias("partners"))
    own = cut_lineage(own.join(partners, [*key, "g"]).select(*key, "g", "g_left", "p", "p_left", "partners"))
    single = own.where("partners = 1").select(*key, "g", "p", F.least("g_left", "p_left").alias("moved"))
    many = own.where("partners > 1")
    if not many.isEmpty():
        summed = running_sum(many.withColumn("of", F.to_json("g")), [*key, "of"], ["p"], {"upto": F.col("p_left")})
        share = F.least(F.col("g_left") - (F.col("upto") - F.col("p_left")), F.col("p_left"))
        single = single.unionByName(summed.select(*key, "g", "p", share.alias("moved")).where("moved > 0"))
    moved = cut_lineage(single)
    by_g = moved.groupBy(*key, "g").agg(F.sum("moved").alias("mg"))
    rest = edges.join(by_g, [*key, "g"], "left").join(moved.select(*key, "p", F.col("moved").alias("mp")), [*key, "p"], "left")
    left = lambda side: (F.col(f"{side}_left") - F.coalesce(f"m{side}", F.lit(0))).alias(f"{side}_left")
    rest = rest.select(*key, "g", left("g"), "p", left("p")).where("g_left > 0 and p_left > 0")
    return moved.select(*key, "moved"), cut_lineage(rest)


def _in_sequence(edges: DataFrame) -> DataFrame:
    """(run_id, task_id, moved) of answers with few edges: gold classes in order, each taking its first partners."""
    key = ["run_id", "task_id"]
    flat = edges.select(
        *key, F.coalesce("g.pos", F.lit(0).cast("long")).alias("g_pos"), F.col("g.sig").alias("g_sig"), "g_left",
        F.coalesce("p.pos", F.lit(0).cast("long")).alias("p_pos"), F.col("p.sig").alias("p_sig"), "p_left",
    )

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["g_pos", "g_sig", "p_pos", "p_sig"])
        want, free, total = {}, {}, 0
        for g, n, p, m in zip(zip(rows.g_pos, rows.g_sig), rows.g_left, zip(rows.p_pos, rows.p_sig), rows.p_left):
            take = min(want.setdefault(g, n), free.setdefault(p, m))
            want[g] -= take
            free[p] -= take
            total += take
        return pd.DataFrame({"run_id": rows.run_id.iloc[:1], "task_id": rows.task_id.iloc[:1], "moved": [total]})

    kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in key)
    return flat.groupBy(*key).applyInPandas(match, f"{kinds}, moved long")


# ---------------------------------------------------------------- columns


def column_names(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Set of column names per answer; equal name lists collapse before anything is exploded."""
    lists = rows.select(*keys, F.transform("cells", lambda c: c["name"]).alias("names")).distinct()
    names = lists.select(*keys, F.explode("names").alias("name")).distinct()
    return names.groupBy(*keys).agg(F.collect_set("name").alias("names"))


def jaccard(gold: Column, pred: Column) -> Column:
    both = F.size(F.array_union(gold, pred))
    return F.when(both > 0, F.size(F.array_intersect(gold, pred)) / both).otherwise(1.0)


def column_signatures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Order-free fingerprint of the value multiset of every column of every answer."""
    if "prep" not in rows.columns:
        rows = rows.withColumn("prep", C.prepare(F.col("cells")))
    named = F.zip_with(
        "cells", "prep", lambda c, p: F.struct(c["name"].alias("n"), p["tok"].alias("t"))
    )
    flat = rows.select(*keys, F.posexplode(named).alias("col_pos", "c")).select(
        *keys, "col_pos", F.col("c.n").alias("col_name"), F.col("c.t").alias("tok")
    )
    # counting tokens first keeps the hash work per distinct value
    counted = flat.groupBy(*keys, "col_name", "tok").agg(
        F.count(F.lit(1)).alias("n"), F.min("col_pos").alias("col_pos")
    )
    first, second = C.fingerprint(F.col("tok"), F.col("n"))
    return counted.groupBy(*keys, "col_name").agg(
        F.min("col_pos").alias("col_pos"),
        F.sum("n").alias("n_rows"),
        first.alias("f1"),
        second.alias("f2"),
    )


def answer_heads(rows: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Heads of typed answers; ``answered`` lists the answers that exist, with or without rows."""
    found = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("cells", F.coalesce("row_pos", F.lit(0))).alias("first"),
    )
    nothing = "named_struct('name', 'value', 'kind', 'null', 'text', cast(null as string))"
    return (
        answered.join(found, keys, "left")
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)).cast("long"))
        .select(
            *answered.columns,
            F.lit("list").alias("shape"),
            "n_rows",
            F.coalesce(
                F.transform("first", lambda c: c["name"]), F.array().cast("array<string>")
            ).alias("columns"),
            F.when(
                (F.col("n_rows") == 1) & (F.size("first") == 1), F.col("first")[0]
            )
            .otherwise(F.expr(nothing))
            .alias("value"),
        )
    )
