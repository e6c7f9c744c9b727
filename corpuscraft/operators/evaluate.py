"""Gold against predicted: accuracy, precision, recall and F1, attachment, confusion, pruning.

Counts come from one aggregation over an alignment; ratios are expressions over its one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import NOT_AN_ARG, SPRL_NIL, is_norel, is_punct, sense_suffix
from .joins import align
from .tables import KEYS
from .windows import chunks


def _ratio(a: str, b: str, empty: float = 0.0) -> Column:
    return F.when(F.col(b) == 0, F.lit(empty)).otherwise(F.col(a) / F.col(b))


def prf(counts: DataFrame, empty: float = 0.0) -> DataFrame:
    """Adds precision, recall and f1 to n_correct, n_pred and n_gold."""
    x = counts.withColumn("precision", _ratio("n_correct", "n_pred", empty)).withColumn("recall", _ratio("n_correct", "n_gold", empty))
    both = F.col("precision") + F.col("recall")
    return x.withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both))


def f1(aligned: DataFrame, gold_nil: Column, pred_nil: Column, correct: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Micro precision, recall and F1. Rows whose prediction is missing (pred null) count as gold and as missing."""
    present = F.col("pred").isNotNull()
    right = correct if correct is not None else F.col("gold").eqNullSafe(F.col("pred"))
    yes = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    counts = aligned.groupBy(*(by or [])).agg(
        yes(present & ~gold_nil & ~pred_nil & right).alias("n_correct"), yes(present & ~pred_nil).alias("n_pred"), yes(~gold_nil).alias("n_gold"), yes(~present).alias("n_missing"), F.count("*").alias("n_total")
    )
    return prf(counts)


def binary_f1(aligned: DataFrame, positive: str = "1", by: list[str] | None = None) -> DataFrame:
    return f1(aligned, ~F.col("gold").eqNullSafe(F.lit(positive)), ~F.col("pred").eqNullSafe(F.lit(positive)), by=by)


def attachment(gold: DataFrame, pred: DataFrame, labeled: bool = False, skip_punct: bool = False) -> DataFrame:
    """Right heads (and labels) among all tokens: n_correct, n_total, score. Missing heads are wrong."""
    layers = ["parent", "deprel"] if labeled else ["parent"]
    x = align(gold, pred.select(*KEYS, "tok", *layers), layers)
    x = x.where(~is_punct("word")) if skip_punct else x
    right = reduce(lambda a, b: a & b, [F.col(f"gold_{c}") == F.col(f"pred_{c}") for c in layers])
    return x.agg(F.count_if(F.coalesce(right, F.lit(False))).alias("n_correct"), F.count("*").alias("n_total")).withColumn("score", _ratio("n_correct", "n_total"))


def tree_exact_match(gold: DataFrame, pred: DataFrame, skip_punct: bool = False) -> DataFrame:
    x = align(gold, pred.select(*KEYS, "tok", "parent"), ["parent"])
    x = x.where(~is_punct("word")) if skip_punct else x
    per = x.groupBy(*KEYS).agg(F.bool_and(F.coalesce(F.col("gold_parent") == F.col("pred_parent"), F.lit(False))).alias("all"))
    return per.agg(F.count_if("all").alias("n_correct"), F.count("*").alias("n_total")).withColumn("score", _ratio("n_correct", "n_total"))


def pos_accuracy(gold: DataFrame, pred: DataFrame, tag: str = "pos") -> DataFrame:
    x = align(gold, pred.select(*KEYS, "tok", tag), [tag])
    right = F.coalesce(F.col(f"gold_{tag}") == F.col(f"pred_{tag}"), F.lit(False))
    return x.agg(F.count_if(right).alias("n_correct"), F.count_if(~right).alias("n_errors"), F.count("*").alias("n_total")).withColumn("score", _ratio("n_correct", "n_total"))


def ner_f1(gold: DataFrame, pred: DataFrame, tag: str = "ne_tag") -> DataFrame:
    """Spans of either side: right if begin, end and type are equal. n_missing counts sentences without any predicted tag."""
    span = ["start", "end"]
    g = chunks(gold, tag).select(*KEYS, *span, F.col("type").alias("g"))
    p = chunks(pred.where(F.col(tag).isNotNull()), tag).select(*KEYS, *span, F.col("type").alias("p"))
    counts = g.join(p, [*KEYS, *span], "full").agg(F.count_if(F.col("g") == F.col("p")).alias("n_correct"), F.count("p").alias("n_pred"), F.count("g").alias("n_gold"))
    return prf(counts)


#: The four scorings of predicates and roles that the suite reports: (labeled, sense, position, roles).
SRL_SCORINGS = {"srl_position": (False, False, True, False), "srl_sense": (True, True, False, False), "srl_roles": (True, False, False, True), "srl_all": (True, True, False, True)}


def srl_scores(gold: DataFrame, pred: DataFrame, scorings: dict[str, tuple[bool, bool, bool, bool]] = SRL_SCORINGS, skip: DataFrame | None = None, suffix: bool = True) -> DataFrame:
    """Precision, recall and F1 of arcs (p, c, label) for each scoring (labeled, sense, position, roles), as rows (kind, ...).

    Arcs with p = -1 hold a predicate's position and sense, others its roles. sense, position: score the former; roles: score
    the latter. Unless positions are scored, only arcs of gold predicates count. Labels are compared if ``labeled``,
    those of predicates only if senses are scored, with ``suffix`` behind their last dot. ``skip`` leaves out pairs (p, c).
    Both sides meet in one shuffle by predicate, whatever the number of scorings.
    """
    head = F.when(F.col("p") == -1, F.col("c")).otherwise(F.col("p")).alias("_q")
    none = F.lit(None).cast("string")
    both = gold.select(*KEYS, head, "p", "c", F.col("label").alias("g"), none.alias("q")).unionByName(pred.select(*KEYS, head, "p", "c", none.alias("g"), F.col("label").alias("q")))
    x = both.repartition(*KEYS, "_q").groupBy(*KEYS, "_q", "p", "c").agg(F.max("g").alias("g"), F.max("q").alias("q"))
    known = F.bool_or((F.col("p") == -1) & F.col("g").isNotNull()).over(Window.partitionBy(*KEYS, "_q"))
    x = x.withColumn("known", known)
    x = x.join(skip.select(*KEYS, "p", "c"), [*KEYS, "p", "c"], "left_anti") if skip is not None else x
    wall, g, q = F.col("p") == -1, F.col("g"), F.col("q")
    rows = []
    for kind, (labeled, sense, position, roles) in scorings.items():
        at = (wall & F.lit(sense or position)) | (~wall & F.lit(roles))
        at = at if position else at & F.col("known")
        same = F.when(wall, (sense_suffix(g) == sense_suffix(q) if suffix else g == q) if sense else F.lit(True)).otherwise(g == q) if labeled else F.lit(True)
        count = lambda c, name: F.count_if(at & c).alias(name)  # noqa: B023, E731
        rows.append(F.struct(F.lit(kind).alias("kind"), count(g.isNotNull() & q.isNotNull() & same, "n_correct"), count(q.isNotNull(), "n_pred"), count(g.isNotNull(), "n_gold")))
    return prf(x.agg(F.array(*rows).alias("x")).select(F.inline("x")))


def srl_f1(gold: DataFrame, pred: DataFrame, labeled: bool = True, sense: bool = True, position: bool = False, roles: bool = True, skip: DataFrame | None = None, suffix: bool = True) -> DataFrame:
    """One of srl_scores; by default senses and roles of the gold predicates."""
    return srl_scores(gold, pred, {"srl": (labeled, sense, position, roles)}, skip, suffix).drop("kind")


def rel_f1(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Pairs with gold and pred labels; a label of no relation is nil."""
    return f1(pairs, is_norel("gold"), is_norel("pred"), by=by)


def pred_id_accuracy(gold: DataFrame, pred: DataFrame, toks: DataFrame) -> DataFrame:
    """Tokens rightly marked as predicate or not, in sentences with a gold predicate."""
    keys = [*KEYS, "tok"]
    at = lambda arc, name: arc.where("p = -1").select(*KEYS, F.col("c").alias("tok"), F.lit(True).alias(name)).distinct()
    inside = toks.select(*keys).join(gold.where("p = -1").select(*KEYS), KEYS, "left_semi")
    x = inside.join(at(gold, "g"), keys, "left").join(at(pred, "q"), keys, "left")
    right = F.coalesce("g", F.lit(False)) == F.coalesce("q", F.lit(False))
    return x.agg(F.count_if(right).alias("n_correct"), F.count("*").alias("n_total")).withColumn("score", _ratio("n_correct", "n_total"))


def pruning_efficiency(mask: DataFrame, toks: DataFrame) -> DataFrame:
    """The share of arcs outside the gold tree that the mask prunes."""
    gold = toks.select(*KEYS, F.col("parent").alias("p"), F.col("tok").alias("c"))
    rest = mask.join(gold, [*KEYS, "p", "c"], "left_anti")
    return rest.agg(F.count_if(~F.col("kept")).alias("n_pruned"), F.count("*").alias("n_total")).withColumn("score", _ratio("n_pruned", "n_total"))


def oracle_pruning(mask: DataFrame, toks: DataFrame) -> DataFrame:
    """Gold arcs that are kept (n_correct of n_total), and sentences in which all are (n_exact of n_sents)."""
    gold = toks.where("parent >= -1").select(*KEYS, F.col("parent").alias("p"), F.col("tok").alias("c"))
    x = gold.join(mask.select(*KEYS, "p", "c", "kept"), [*KEYS, "p", "c"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    per = x.groupBy(*KEYS).agg(F.count_if("kept").alias("k"), F.count("*").alias("n"))
    return per.agg(F.sum("k").alias("n_correct"), F.sum("n").alias("n_total"), F.count_if(F.col("k") == F.col("n")).alias("n_exact"), F.count("*").alias("n_sents"))


def confusion(aligned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each (gold, pred), each category, and of all categories together (category null)."""
    if not by:
        return aligned.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    return aligned.groupingSets([[*map(F.col, by), F.col("gold"), F.col("pred")], [F.col("gold"), F.col("pred")]], *by, "gold", "pred").agg(F.count("*").alias("n"))


def confusion_grid(cells: DataFrame, labels: list[str]) -> DataFrame:
    """The cells as a grid: a row a gold label, a column a predicted one, and the totals."""
    grid = cells.groupBy("gold").pivot("pred", labels).agg(F.sum("n")).na.fill(0)
    return grid.withColumn("total", sum((F.col(f"`{x}`") for x in labels), F.lit(0)))


def confusion_scores(cells: DataFrame, nil: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy of confusion cells. Empty denominators give 1."""
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    same, g, p = F.col("gold") == F.col("pred"), ~F.col("gold").isin(*nil), ~F.col("pred").isin(*nil)
    x = cells.groupBy(*(by or [])).agg(count(same & g).alias("n_correct"), count(p).alias("n_pred"), count(g).alias("n_gold"), count(same).alias("n_same"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_total"))
    return prf(x, 1.0).withColumn("accuracy", _ratio("n_same", "n_total", 1.0)).drop("n_same")


def examples_per_cell(aligned: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """The n shortest examples of each cell. Spark keeps n of a cell in each task before any are shuffled."""
    rank = F.row_number().over(Window.partitionBy("gold", "pred").orderBy(F.length(text), key)) - 1
    return aligned.withColumn("rank", rank).where(F.col("rank") < n).select("gold", "pred", "rank", key)


def majority_baseline(cells: DataFrame, nil: list[str], by: list[str] | None = None) -> DataFrame:
    """Always guessing the commonest label that isn't nil: label, n_correct, precision, recall and f1."""
    by = by or []
    gold = cells.groupBy(*by, "gold").agg(F.sum("n").alias("n"))
    real = ~F.col("gold").isin(*nil)
    x = gold.groupBy(*by).agg(
        F.max(F.when(real, F.struct("n", "gold"))).alias("top"), F.sum("n").alias("n_pred"), F.coalesce(F.sum(F.when(real, F.col("n"))), F.lit(0)).cast("long").alias("n_gold")
    )
    counts = x.select(*by, F.col("top.gold").alias("label"), F.coalesce("top.n", F.lit(0)).cast("long").alias("n_correct"), F.when(F.col("top").isNull(), 0).otherwise(F.col("n_pred")).cast("long").alias("n_pred"), "n_gold")
    return prf(counts, 1.0)


def category_max_f1(cells: DataFrame, nil: list[str], category: str) -> DataFrame:
    """For each category, whether guessing its majority or nil gives the best F1 over all: category, guess, and that F1.

    A choice of categories has F1 = 2C / (P + G). It beats a ratio f if 2C - fP > fG, and the left side is largest with just the
    categories whose own 2c - fp is positive. So f rises from 0 to the F1 of that choice until it stays: a few
    sums over the categories, whatever their number.
    """
    base = majority_baseline(cells, nil, [category])  # a row a category
    gain = lambda f: 2 * F.col("n_correct") - F.lit(f) * F.col("n_pred") > 0
    best = 0.0
    while True:
        own = lambda c: F.sum(F.when(gain(best), F.col(c)).otherwise(0))  # noqa: B023, E731
        c, p, g = base.agg(own("n_correct"), own("n_pred"), F.sum("n_gold")).first()
        f = 2 * c / (p + g) if c else 0.0
        if f <= best:
            break
        best = f
    return base.select(category, F.when(gain(best), F.col("label")).otherwise(nil[0]).alias("guess"), F.lit(best).alias("f1"))


def sprl_scores(pairs: DataFrame, gold: DataFrame, pred: DataFrame, nil: tuple[str, ...] = SPRL_NIL) -> tuple[DataFrame, DataFrame]:
    """Confusion cells by property (null: of all), and their scores. What counts are the properties that gold labels on the candidate pairs (pred, arg); a pair that the prediction lacks is no argument."""
    keys = [*KEYS, "pred", "arg"]
    known = gold.join(pairs.select(*keys).distinct(), keys, "left_semi").select(*keys, "property", F.col("label").alias("gold"))
    x = known.join(pred.select(*keys, "property", F.col("label").alias("pred_label")), [*keys, "property"], "left")
    cells = confusion(x.select("property", "gold", F.coalesce("pred_label", F.lit(NOT_AN_ARG)).alias("pred")), ["property"])
    return cells, confusion_scores(cells, list(nil), ["property"])


def mask_counts(mask: DataFrame) -> DataFrame:
    """Kept arcs and the fewest kept heads of a token, a sentence; a token without a kept head is an error."""
    return head_counts(mask.groupBy(*KEYS, "c").agg(F.count_if("kept").alias("n")))


def head_counts(per: DataFrame) -> DataFrame:
    """mask_counts, given the number n of each token's kept heads."""
    least = F.when(F.min("n") == 0, F.raise_error(F.lit("a token has no head left")).cast("long")).otherwise(F.min("n"))
    return per.groupBy(*KEYS).agg(F.sum("n").alias("n_kept"), least.alias("least_heads"))


def evaluate_all(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """All token metrics of two token tables over one alignment, as (metric, n_correct, n_total, score) rows.

    Layers that one side lacks are left out.
    """
    layers = [c for c in ("pos", "parent", "deprel", "ne_tag", "chunk", "cluster", "lemma") if c in gold.columns and c in pred.columns]
    x = align(gold, pred.select(*KEYS, "tok", *layers), layers)
    same = {c: F.coalesce(F.col(f"gold_{c}") == F.col(f"pred_{c}"), F.lit(False)) for c in layers}
    tests = {f"{c}_accuracy": (same[c], F.lit(True)) for c in layers}
    if "parent" in layers:
        tests |= {"uas": (same["parent"], F.lit(True)), "uas_no_punct": (same["parent"], ~is_punct("word"))}
        if "deprel" in layers:
            tests |= {"las": (same["parent"] & same["deprel"], F.lit(True)), "las_no_punct": (same["parent"] & same["deprel"], ~is_punct("word"))}
    per = x.groupBy(*KEYS).agg(*(f for m, (ok, at) in tests.items() for f in (F.count_if(ok & at).alias(f"{m}_c"), F.count_if(at).alias(f"{m}_n"))))
    rows = []
    for m in tests:
        rows.append(F.struct(F.lit(m).alias("metric"), F.sum(f"{m}_c").alias("n_correct"), F.sum(f"{m}_n").alias("n_total")))
        if m == "parent_accuracy" or m.startswith("uas"):
            rows.append(F.struct(F.lit(f"{m}_exact").alias("metric"), F.count_if(F.col(f"{m}_c") == F.col(f"{m}_n")).alias("n_correct"), F.count("*").alias("n_total")))
    return per.agg(F.array(*rows).alias("x")).select(F.inline("x")).withColumn("score", _ratio("n_correct", "n_total"))


def evaluate_suite(gold: dict[str, DataFrame], pred: dict[str, DataFrame], skip_punct: bool = False) -> DataFrame:
    """All metrics of two corpora: (metric, n_correct, n_pred, n_gold, score), score = 2 n_correct / (n_pred + n_gold), which for a share of n is n_correct / n.

    Each corpus is tables by name, and what one lacks is left out: tokens; arcs (p, c, label); props (pred, arg, property, label);
    labels (k, label: of mention pairs); heads (candidate_heads of the prediction). Every table is aligned once.
    """
    rows: list[DataFrame] = []

    def share(df: DataFrame, names: dict[str, tuple[str, str]]) -> None:
        """Metrics that are a count of another, both columns of the one row."""
        cells = [F.struct(F.lit(m).alias("metric"), *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(n) for n, c in zip(("n_correct", "n_pred", "n_gold"), (part, whole, whole)))) for m, (part, whole) in names.items()]
        rows.append(df.select(F.inline(F.array(*cells))))

    def scores(df: DataFrame, metric: Column) -> None:
        rows.append(df.select(metric.alias("metric"), "n_correct", "n_pred", "n_gold"))

    both = set(gold) & set(pred)
    if "heads" in pred:
        from .pairs import heads_report

        share(heads_report(pred["heads"], skip_punct), {"pruning_efficiency": ("n_pruned", "n_total"), "oracle_pruning_accuracy": ("n_gold_kept", "n_gold"), "oracle_pruning_exact": ("n_exact", "n_sents")})
    if "tokens" in both:
        rows.append(evaluate_all(gold["tokens"], pred["tokens"]).select("metric", "n_correct", F.col("n_total").alias("n_pred"), F.col("n_total").alias("n_gold")))
        layers = [c for c in pred["tokens"].columns if c not in (*KEYS, "tok")]
        per = pred["tokens"].groupBy(*KEYS).agg(*(F.bool_and(F.col(c).isNotNull()).alias(c) for c in layers))
        have = per.agg(F.count("*").alias("_n"), *(F.count_if(c).alias(c) for c in layers))
        share(have, {f"annotated_{c}": (c, "_n") for c in layers})
    if "arcs" in both:
        share(pred_id_accuracy(gold["arcs"], pred["arcs"], gold["tokens"]), {"predicate_accuracy": ("n_correct", "n_total")})
        share(pred["arcs"].agg(F.count_if(F.col("p") == F.col("c")).alias("loops"), F.count("*").alias("n")), {"self_loops": ("loops", "n")})
        scores(srl_scores(gold["arcs"], pred["arcs"]), F.col("kind"))
    if "props" in both:
        given = gold["arcs"].where("p >= 0").select(*KEYS, F.col("p").alias("pred"), F.col("c").alias("arg")) if "arcs" in gold else gold["props"]
        cells, found = sprl_scores(given, gold["props"], pred["props"])
        scores(found, F.coalesce(F.concat(F.lit("sprl_"), "property"), F.lit("sprl")))
        scores(sprl_scores(given.where("pred <> arg"), gold["props"], pred["props"])[1].where("property is null"), F.lit("sprl_no_loops"))
        majority = majority_baseline(cells, list(SPRL_NIL), ["property"])
        scores(majority, F.concat(F.lit("sprl_majority_"), F.coalesce("property", F.lit("all"))))
    if "labels" in both:
        keys = [*KEYS, "k"]
        pairs = gold["labels"].select(*keys, F.col("label").alias("gold")).join(pred["labels"].select(*keys, F.col("label").alias("pred")), keys, "left")
        scores(rel_f1(pairs), F.lit("relations"))
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("score", F.when(F.col("n_pred") + F.col("n_gold") == 0, 0.0).otherwise(2 * F.col("n_correct") / (F.col("n_pred") + F.col("n_gold"))))
