"""Checks of a rubric before it is frozen: eight that block and three that warn.

Statements are judged by their form: a claim has a finite verb of a list that callers may extend. Nothing is parsed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The limits of the checks.
MOST_WORDS, LEAST_EXEMPLARS, ALIKE, HEAVY, COARSE_MARKS, COARSE_POINTS = 30, 2, 0.90, 0.40, 15, 5
#: Verbs by which a statement, or each side of its "and", makes a claim.
VERBS = tuple(
    "is are was were be been has have had do does did can could may might must shall should will would cannot states defines explains identifies describes gives names lists shows uses applies requires "
    "holds means causes contains includes allows prevents occurs needs depends produces leads increases decreases waits releases requests reduces becomes remains follows implies".split()
)
ASKING = "what why how when where who whom whose which".split()
NEGATION = r"\b(?:not|never|no|none|nor|neither|cannot|without)\b|n't\b"
#: A question's points are compared in blocks of BLOCK_ROWS, in BLOCKS larger ones if there would be more, and in more again if such a block
#: had over BLOCK_VALUES components; a rubric is one block. MATRIX_ROWS of one block meet another block at a time.
BLOCK_ROWS, BLOCKS, BLOCK_VALUES, MATRIX_ROWS = 1024, 8, 1 << 21, 256


def claims(verbs: Sequence[str] = VERBS) -> str:
    return rf"\b(?:{'|'.join(verbs)})\b"


def conjoined(statement: Column, verbs: Sequence[str] = VERBS) -> Column:
    """Two claims joined by "and": a verb on either side of it."""
    return F.lower(statement).rlike(rf"(?s){claims(verbs)}.*\s+and\s+.*{claims(verbs)}")


def declarative(statement: Column, verbs: Sequence[str] = VERBS) -> Column:
    """A sentence with a verb that doesn't ask."""
    asks = F.trim(statement).endswith("?") | F.lower(statement).rlike(rf"^\s*(?:{'|'.join(ASKING)})\b")
    return F.coalesce(~asks & F.lower(statement).rlike(claims(verbs)), F.lit(False))


def words(statement: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(statement, F.lit(""))), r"\s+"), lambda w: w != ""))


def alike(points: DataFrame, limit: float = ALIKE, vector: str = "vector") -> DataFrame:
    """(question, a, b): points of a question whose vectors have a cosine above ``limit``; a is the smaller code.

    A question's points are dealt into blocks, and each two blocks meet in a cell of their own, one matrix after another, whose pairs leave as
    they are found: a rubric is one cell, a question of any size many, spread over all tasks whatever their pairs. A point is sent to as many cells as
    there are blocks. Points without a vector, or with one of length 0, are alike to none.
    """
    own = points.filter(F.col(vector).isNotNull() & F.col("code").isNotNull()).select("question", "code", F.col(vector).cast("array<double>").alias("v"))
    few = F.least(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(BLOCKS))
    counts = own.groupBy("question").agg(F.greatest(few, F.ceil(F.sum(F.size("v")) / BLOCK_VALUES)).cast("long").alias("blocks"))
    dealt = own.join(counts, "question").withColumn("block", F.pmod(F.xxhash64("code"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = ["question", "dim", "low", "high"]
    cells = dealt.select("question", F.size("v").alias("dim"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), "code", "v")
    kind, tasks = {f.name: f.dataType.simpleString() for f in own.schema}, 4 * points.sparkSession.sparkContext.defaultParallelism

    def meet(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (question, dim, low, high) = pa.Table.from_batches(batches), key
        distinct, ids = np.unique(np.fromiter(table["code"].to_pylist(), object, len(table)), return_inverse=True)
        names, order = pa.array(distinct.tolist(), table.schema.field("code").type), np.argsort(ids, kind="stable")
        m = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), dim.as_py())
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m, ids, second = np.divide(m, size, out=np.zeros_like(m), where=size > 0)[order], ids[order], table["second"].to_numpy()[order]
        (x, i_ids), (y, j_ids) = ((m, ids), (m, ids)) if low == high else ((m[~second], ids[~second]), (m[second], ids[second]))
        x_single, y_single, slack = x.astype("f4"), y.astype("f4"), (m.shape[1] + 2) * 2.0**-23  # more than single precision takes from a cosine
        cuts = np.unique(np.searchsorted(i_ids, i_ids[::MATRIX_ROWS])).tolist()  # rows of one code stay together
        for start, end in zip(cuts, [*cuts[1:], len(x)]):
            near = (x_single[start:end] @ y_single.T).ravel()
            at = np.flatnonzero(near > limit - slack)
            if (near[at] <= limit + slack).any():
                at = np.flatnonzero(x[start:end] @ y.T > limit)
            i, j = np.divmod(at, max(len(y), 1))
            if low == high:
                i, j = i[j > i + start], j[j > i + start]
            i, j = i_ids[i + start], j_ids[j]
            a, b = np.minimum(i, j), np.maximum(i, j)
            if len(distinct) < len(table):
                a, b = np.divmod(np.unique(a * len(distinct) + b), len(distinct))
            yield pa.RecordBatch.from_arrays([pa.repeat(question, len(a)), names.take(pa.array(a)), names.take(pa.array(b))], ["question", "a", "b"])

    return cells.repartition(tasks, *cell).groupBy(*cell).applyInArrow(meet, f"question {kind['question']}, a {kind['code']}, b {kind['code']}")


def lint(points: DataFrame, questions: DataFrame, verbs: Sequence[str] = VERBS) -> DataFrame:
    """(rule, severity, question, code) for points (question, code, statement, marks, exemplars, group_id, group_max, requires, vector) and questions (question, max_marks).

    ``code`` names the point, the group for GROUP_CAP, both points for ALIKE, nothing for rules on a question. Without a column
    ``vector`` no points are compared. Rules on the same rows are judged in one pass, as each pass makes the points anew.
    """
    key = lambda df, rule, level, code="code": df.select(F.lit(rule).alias("rule"), F.lit(level).alias("severity"), "question", F.col(code).cast("string").alias("code"))
    each = lambda df, code, *rules: df.select("question", code.cast("string").alias("code"), F.inline(F.filter(F.array(*(F.when(broken, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity"))) for rule, level, broken in rules)), lambda r: r.isNotNull()))).select("rule", "severity", "question", "code")
    sums = points.groupBy("question").agg(F.sum("marks").alias("total"), F.count("*").alias("n"))
    groups = points.filter("group_id is not null").groupBy("question", "group_id").agg(F.count("*").alias("size"), F.max("group_max").alias("cap"))
    codes = points.select("question", F.col("code").alias("requires"))
    s, most = F.col("statement"), F.col("max_marks")
    found = [
        each(
            points, F.col("code"),
            ("CONJOINED", "BLOCK", conjoined(s, verbs)), ("NOT_DECLARATIVE", "BLOCK", ~declarative(s, verbs)), ("TOO_LONG", "BLOCK", words(s) > MOST_WORDS),
            ("FEW_EXEMPLARS", "BLOCK", F.coalesce(F.size("exemplars"), F.lit(0)) < LEAST_EXEMPLARS), ("NEGATION", "WARN", F.lower(s).rlike(NEGATION)),
        ),
        each(questions.join(sums, "question", "left"), F.lit(None), ("MARKS_SUM", "BLOCK", F.coalesce("total", F.lit(0.0)) != most), ("COARSE", "WARN", (most > COARSE_MARKS) & (F.coalesce("n", F.lit(0)) < COARSE_POINTS))),
        key(points.filter("requires is not null").join(codes, ["question", "requires"], "left_anti"), "REQUIRES", "BLOCK"),
        key(cycles(points), "REQUIRES", "BLOCK"),
        key(groups.filter("cap > size"), "GROUP_CAP", "BLOCK", "group_id"),
        key(points.join(questions, "question").filter(F.col("marks") > most * HEAVY), "HEAVY_POINT", "WARN"),
    ]
    if "vector" in points.columns:
        found.append(key(alike(points).withColumn("code", F.concat_ws(" ", "a", "b")), "ALIKE", "BLOCK"))
    return reduce(DataFrame.unionByName, found)


def freezable(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions that no blocking rule holds back."""
    return questions.join(found.filter("severity = 'BLOCK'").select("question").distinct(), "question", "left_anti")


def on_cycles(requirements: Iterable[tuple]) -> list:
    """Codes that lead back to themselves, of (code, required code): Tarjan's strong components without recursion, linear in time and memory."""
    after: dict = {}
    for code, to in requirements:
        after.setdefault(code, []).append(to)
    number, low, path, held, found = {}, {}, [], set(), []
    for first in after:
        todo = [] if first in number else [(first, None)]
        while todo:
            code, rest = todo.pop()
            if rest is None:
                number[code] = low[code] = len(number)
                path.append(code)
                held.add(code)
                rest = iter(after[code])
            for to in rest:
                if to in after and to not in number:
                    todo += [(code, rest), (to, None)]
                    break
                if to in held:
                    low[code] = min(low[code], number[to])
            else:
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[code])
                if low[code] == number[code]:
                    ring = []
                    while not ring or ring[-1] != code:
                        ring.append(path.pop())
                    held.difference_update(ring)
                    found += ring if len(ring) > 1 or code in after[code] else []
    return found


def cycles(points: DataFrame) -> DataFrame:
    """(question, code) of points that require themselves over any number of steps.

    A point on a cycle requires one that requires and is required by one that does; a question's distinct requirements of that kind meet in one task.
    """
    edges = points.filter("requires is not null and code is not null").select("question", "code", F.col("requires").alias("to")).distinct()
    same = lambda a, b: F.col("e.question").eqNullSafe(F.col("o.question")) & (F.col(f"e.{a}") == F.col(f"o.{b}"))
    kept = edges.alias("e").join(edges.alias("o"), same("to", "code"), "left_semi").join(edges.alias("o"), same("code", "to"), "left_semi")
    kind = {f.name: f.dataType.simpleString() for f in edges.schema}

    def closed(table: pa.Table) -> pa.Table:
        found = on_cycles(zip(table["code"].to_pylist(), table["to"].to_pylist()))
        return pa.table({"question": table["question"].slice(0, len(found)), "code": pa.array(found, table.schema.field("code").type)})

    return kept.groupBy("question").applyInArrow(closed, f"question {kind['question']}, code {kind['code']}")
