"""Column relaxations: accept an answer that carries every needed column plus others.

For each failed (run, task) the columns of both sides meet by value fingerprint. Most answers leave one
choice of predicted columns, which a grouping finds. For the others, predicted columns that are equal in every row
are one class, since comparison ignores names and order, and choices are grown as multisets of classes, one gold column
at a time. When the choices of an answer become many, those go whose rows, as far as they are chosen, are not those
of the gold answer. Each complete choice turns the prediction into a projected answer with its own id, and the
ordinary comparison decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import cells as C
from assayer.operators import compare as K
from assayer.session import cut_lineage

#: Fixed value: mappings of gold to predicted columns beyond which an answer without a valid one is ambiguous.
MAPPINGS = 4096
KEY = ["run_id", "task_id"]


def column_choices(candidates: DataFrame, gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run_id, task_id, pred_cols): sets of distinct predicted columns, one for each gold column.

    ``candidates`` of ``column_candidates``. All choices are given while an answer has at most ``MAPPINGS`` of them; beyond that
    those that fit the gold rows so far, at most that many.
    """
    per_column = candidates.groupBy(*KEY, "gold_pos").agg(F.count(F.lit(1)).alias("options"))
    only = per_column.groupBy(*KEY).agg(F.max("options").alias("options")).where("options = 1").select(*KEY)
    single = candidates.join(only, KEY, "left_semi").groupBy(*KEY).agg(F.collect_list("pred_col").alias("pred_cols"))
    hard = cut_lineage(candidates.join(only, KEY, "left_anti"))
    if hard.isEmpty():
        return single
    return single.unionByName(_grown(hard, gold, pred, pairs))


def _classes(candidates: DataFrame, pred: DataFrame) -> DataFrame:
    """(run_id, task_id, pred_col, cls): candidate columns with the first position of a column equal to them in every row."""
    wanted = candidates.select(*KEY, "pred_col", "pred_pos").distinct()
    rows = pred.join(wanted.select(*KEY).distinct(), KEY, "left_semi").withColumn("row", F.xxhash64(F.transform("prep", lambda c: c["tok"])))
    cells = F.zip_with("cells", "prep", lambda c, p: F.struct(c["name"].alias("pred_col"), p["tok"].alias("tok")))
    flat = rows.select(*KEY, "row", F.explode(cells).alias("c")).select(*KEY, "row", "c.*")
    first, second = C.fingerprint(F.concat_ws(":", "row", "tok"))
    found = flat.groupBy(*KEY, "pred_col").agg(first.alias("f1"), second.alias("f2")).join(wanted, [*KEY, "pred_col"])
    same = Window.partitionBy(*KEY, "f1", "f2")
    return found.select(*KEY, "pred_col", "pred_pos", F.min("pred_pos").over(same).alias("cls"))


def _grown(candidates: DataFrame, gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Choices of answers with several candidates for a gold column."""
    classes = cut_lineage(_classes(candidates, pred))
    columns = classes.groupBy(*KEY, "cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("pred_pos", "pred_col"))), lambda x: x["pred_col"]).alias("cols"))
    found = candidates.join(classes.drop("pred_pos"), [*KEY, "pred_col"])
    options = found.groupBy(*KEY, "gold_pos", "cls").agg(F.count(F.lit(1)).alias("held"))
    # gold columns of the same candidates one after the other, those with few candidates first
    per_column = options.groupBy(*KEY, "gold_pos").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("like"))
    order = per_column.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("n", "like", "gold_pos"))).alias("steps"))
    order = order.withColumn("steps", F.transform("steps", lambda x: x["gold_pos"]))
    options, order = cut_lineage(options), cut_lineage(order)
    done, open_ = None, order.withColumn("picks", F.array().cast("array<int>"))
    width = order.agg(F.max(F.size("steps"))).first()[0]
    for step in range(width):
        now = open_.withColumn("gold_pos", F.get("steps", F.lit(step))).join(options, [*KEY, "gold_pos"])
        now = now.where(F.size(F.filter("picks", lambda x: x == F.col("cls"))) < F.col("held"))
        now = now.select(*KEY, "steps", F.array_sort(F.array_append("picks", F.col("cls"))).alias("picks")).distinct()
        now = cut_lineage(now)
        many = now.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAPPINGS).select(*KEY)
        many = cut_lineage(many)
        if not many.isEmpty():
            fitting = _fitting(now.join(many, KEY, "left_semi"), step + 1, gold, pred, classes, pairs)
            first = F.row_number().over(Window.partitionBy(*KEY).orderBy("picks"))  # of MAPPINGS times the candidates of a column
            fitting = fitting.withColumn("place", first).where(F.col("place") <= MAPPINGS).drop("place")
            now = cut_lineage(now.join(many, KEY, "left_anti").unionByName(fitting))
        ended = now.where(F.size("steps") == step + 1).select(*KEY, "picks")
        done = ended if done is None else done.unionByName(ended)
        open_ = now.where(F.size("steps") > step + 1)
    each = done.select(*KEY, "picks", F.explode(F.array_distinct("picks")).alias("cls")).join(columns, [*KEY, "cls"])
    taken = F.slice("cols", F.lit(1), F.size(F.filter("picks", lambda x: x == F.col("cls"))))
    return each.select(*KEY, "picks", taken.alias("cols")).groupBy(*KEY, "picks").agg(F.flatten(F.collect_list("cols")).alias("pred_cols")).drop("picks")


def _fitting(choices: DataFrame, size: int, gold: DataFrame, pred: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``choices`` under which the rows of ``size`` gold columns and of the columns picked for them are the same multiset.

    Numbers are told apart only where no two different ones of the gold answer are within its tolerance, so
    that equality within the tolerance is equality here.
    """
    tasks = choices.select("task_id").distinct()
    limits = pairs.groupBy("task_id").agg(F.max("abs_tol").alias("abs_tol"), F.max("rel_tol").alias("rel_tol"))
    mine = gold.join(tasks, "task_id", "left_semi")
    value = lambda c: F.when(c["kind"] == "bool", (c["text"] == "true").cast("double")).otherwise(c["dbl"])
    numbers = mine.select("task_id", F.explode("prep").alias("c")).select(
        "task_id", value(F.col("c")).alias("v"), F.coalesce("c.places", F.lit(0)).alias("places")
    ).where("v is not null").groupBy("task_id", "v").agg(F.min("places").alias("places")).join(limits, "task_id")
    reach = F.lit(0.5) * F.pow(F.lit(10.0), -F.col("places")) + F.col("abs_tol") + (F.col("rel_tol") + 1e-15) * (F.abs("v") + 1)
    reach = numbers.groupBy("task_id").agg(F.max(reach).alias("reach"))
    # numbers of one cell are close; those of neighbouring cells are if the gap between them is
    cell = F.floor(F.col("v") / F.col("reach")).alias("cell")
    cells = numbers.join(reach, "task_id").groupBy("task_id", "reach", cell).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    next_ = cells.select("task_id", (F.col("cell") - 1).alias("cell"), F.col("low").alias("next"))
    close = cells.join(next_, ["task_id", "cell"], "left").where("high > low or next - high <= reach").select("task_id").distinct()
    tasks = cut_lineage(tasks.join(close.withColumn("close", F.lit(True)), "task_id", "left"))

    def token(c: Column) -> Column:
        number = value(c).isNotNull()
        plain = F.when(c["kind"] == "bool", F.when(c["text"] == "true", "num:1.").otherwise("num:.")).otherwise(c["tok"])
        return F.when(number & F.coalesce("close", F.lit(False)), F.lit("num")).otherwise(plain)

    def print_(rows: DataFrame, by: list[str], tokens: Column) -> DataFrame:
        row = F.to_json(F.array_sort(tokens))
        first, second = C.fingerprint(F.col("row"))
        return rows.select(*by, row.alias("row")).groupBy(*by).agg(first.alias("f1"), second.alias("f2"))

    steps = choices.select("task_id", F.slice("steps", 1, size).alias("steps")).distinct()
    gold_rows = mine.join(steps, "task_id").join(tasks, "task_id")
    want = print_(gold_rows, ["task_id", "steps"], F.transform("steps", lambda i: token(F.get("prep", i))))
    rows = pred.join(choices.withColumn("first", F.slice("steps", 1, size)), KEY).join(tasks, "task_id")
    have = print_(rows, [*KEY, "steps", "first", "picks"], F.transform("picks", lambda i: token(F.get("prep", i))))
    kept = have.alias("h").join(want.alias("w"), (F.col("h.task_id") == F.col("w.task_id")) & (F.col("h.first") == F.col("w.steps")) & (F.col("h.f1") == F.col("w.f1")) & (F.col("h.f2") == F.col("w.f2")))
    return kept.select("h.run_id", "h.task_id", "h.steps", "h.picks")


def squared(columns: str) -> Column:
    """The row's cells for exactly the named columns; one it lacks becomes a null cell."""
    return F.expr(
        f"transform({columns}, n -> coalesce(try_element_at(filter(cells, c -> c.name = n), 1), "
        "named_struct('name', n, 'kind', 'null', 'text', cast(null as string))))"
    )


def column_candidates(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """(run, task, gold column, predicted column, ``ways``) with equal value fingerprints.

    Only answers in which the gold columns find partners of their own are kept; ``ways`` is the logarithm of the
    number of mappings.
    """
    g = K.column_signatures(gold, ["task_id"]).select(
        "task_id", F.col("col_name").alias("gold_col"), F.col("col_pos").alias("gold_pos"),
        "n_rows", "f1", "f2",
    )
    p = K.column_signatures(pred.join(pairs.select(*KEY), KEY, "left_semi"), KEY).select(
        *KEY, F.col("col_name").alias("pred_col"), F.col("col_pos").alias("pred_pos"), "n_rows", "f1", "f2",
    )
    needed = g.groupBy("task_id").agg(F.count(F.lit(1)).alias("gold_width"))
    values = ["task_id", "n_rows", "f1", "f2"]
    g, p = cut_lineage(g), cut_lineage(p)
    wanted, given = g.groupBy(*values).agg(F.count(F.lit(1)).alias("g")), p.groupBy("run_id", *values).agg(F.count(F.lit(1)).alias("p"))
    ways = F.aggregate(F.sequence(F.lit(0), F.col("g").cast("int") - 1), F.lit(0.0), lambda acc, i: acc + F.log(F.col("p") - i))
    fit = given.join(wanted, values).where("p >= g").select(*KEY, "g", ways.alias("ways"))
    whole = fit.groupBy(*KEY).agg(F.sum("g").alias("found"), F.sum("ways").alias("ways")).join(needed, "task_id").where("found = gold_width")
    return p.join(g, values).select(*KEY, "gold_col", "gold_pos", "pred_col", "pred_pos").join(whole.select(*KEY, "ways"), KEY)


def try_mappings(gold: DataFrame, pred: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdict per (run, task) of ``pairs``: ``pass``, or ``ambiguous`` where none of more than ``MAPPINGS`` passes; a missing row means none.

    ``pairs``: run_id, task_id, method_class, gold_rows, abs_tol, rel_tol.
    """
    candidates = cut_lineage(column_candidates(gold, pred, pairs))
    pred = pred if "prep" in pred.columns else pred.withColumn("prep", C.prepare(F.col("cells")))
    choices = column_choices(candidates, gold, pred, pairs)
    # the id of a projected answer stands in for the run id of the ordinary comparison
    trial = F.concat_ws("#", F.to_json("pred_cols"), "run_id")
    choices = cut_lineage(choices.withColumn("trial", trial))
    plan = choices.join(pairs, KEY)
    projected = pred.join(choices, KEY).select(
        F.col("trial").alias("run_id"),
        "task_id",
        "row_pos",
        squared("pred_cols").alias("cells"),
    )
    projected = cut_lineage(K.signed(projected))
    trials = plan.select(
        F.col("trial").alias("run_id"),
        F.col("run_id").alias("of_run"),
        "task_id",
        "method_class",
        "abs_tol",
        "rel_tol",
        "gold_rows",
    )
    exact = _exact(gold, projected, trials)
    passed = exact.where("exact").select(F.col("of_run").alias("run_id"), "task_id").distinct()
    passed = cut_lineage(passed.withColumn("relaxed", F.lit("pass")))
    many = candidates.where(F.col("ways") > F.log(F.lit(MAPPINGS + 0.5))).select(*KEY).distinct()
    return passed.unionByName(many.join(passed, KEY, "left_anti").withColumn("relaxed", F.lit("ambiguous")))


def _exact(gold: DataFrame, pred: DataFrame, trials: DataFrame) -> DataFrame:
    """``exact`` of each trial under its own method; equal row counts are given."""
    in_order = F.col("method_class") == "ordered"
    by_set = cut_lineage(
        K.set_match(gold, pred, trials).select(*trials.columns, F.col("exact").alias("same_set"))
    )
    tolerance = trials.select("task_id", "abs_tol", "rel_tol").distinct()
    ordered = trials.where(in_order).select("run_id", "task_id")
    places = K.ordered_hits(
        gold, pred.join(ordered, ["run_id", "task_id"], "left_semi"), tolerance
    )
    open_pairs = by_set.where(~in_order & ~F.col("same_set")).select(
        "run_id",
        "task_id",
        "gold_rows",
        F.col("gold_rows").alias("pred_rows"),
        "abs_tol",
        "rel_tol",
        F.lit(False).alias("in_order"),
    )
    greedy = K.greedy_assignment(gold, pred, open_pairs)
    return (
        by_set.join(places, ["run_id", "task_id"], "left")
        .join(greedy, ["run_id", "task_id"], "left")
        .withColumn(
            "exact",
            F.when(in_order, F.coalesce(F.col("in_place") == F.col("gold_rows"), F.lit(False)))
            .when(F.col("same_set"), F.lit(True))
            .otherwise(F.coalesce(F.col("matched") == F.col("gold_rows"), F.lit(False))),
        )
    )
