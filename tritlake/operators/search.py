"""Searches over parameter tables, on the validation queries only. Each query is scored under all parameters at once, in its own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 10
#: The lists of the searches.
STATIC = {"grid": (0, 1), "cent": (0, 25, 50, 100), "prof": (0, 8, 16), "div": (50, 100, 200, 400), "gdiv": (50, 100, 200, 400), "scale": (20, 50, 100)}
BAYES = {"decay": (1, 2, 3, 5, 10, 20, 50), "first": (3, 5, 7, 10, 15, 20, 50), "topo": (0, 50, 100, 200)}
RECURRENT = {"gain": (1, 2, 4, 8, 16), "inertia": (2, 5, 10, 20, 50), "penalty": (0, 1, 5, 10, 50), "first": (3, 5, 10, 20, 50)}
PIPELINE = {"decay": (2, 5, 10), "first_a": (3, 5, 10), "topo": (0, 100), "gain": (2, 4, 8), "inertia": (5, 10, 20), "penalty": (1, 5, 10), "first_b": (5, 10, 20, 50)}


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer quotient, truncated towards zero."""
    return np.sign(a) * (np.abs(a) // b)


def searched(candidates: DataFrame, table: dict[str, tuple[int, ...]], cols: list[str], answer: Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], np.ndarray]) -> DataFrame:
    """(the table's columns, n, correct) for every combination.

    `answer(candidate columns in rank order, parameter columns)` gives a class for each combination; a query's candidates
    are bounded by the retrieval's k. Only counts leave a task, one for each combination.
    """
    params = np.array(list(product(*table.values())), np.int64)
    named = dict(zip(table, params.T, strict=True))
    rows = candidates.groupBy("qid", "label").agg(F.array_sort(F.collect_list(F.struct("place", *cols))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, n = np.zeros(len(params), np.int64), 0
        for b in batches:
            for label, cells in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                right += answer({c: np.array([x[c] for x in cells], np.int64) for c in cols}, named) == label
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(params)), pa.int64()), pa.array(np.full(len(params), n)), pa.array(right)], names=["k", "n", "correct"])

    counted = rows.mapInArrow(run, "k long, n long, correct long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("correct").alias("correct"))
    spark = candidates.sparkSession
    listed = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(params)], ", ".join(["k long", *(f"{c} int" for c in table)]))
    return listed.join(counted, "k").select(*table, "n", "correct")


def best_of(found: DataFrame, table: dict[str, tuple[int, ...]]) -> DataFrame:
    """The combination with most right answers; of equals the first in the order of the lists."""
    place = [F.array_position(F.array(*(F.lit(v) for v in values)), F.col(c)) for c, values in table.items()]
    return found.orderBy(F.desc("correct"), *place).limit(1)


def _majority(labels: np.ndarray) -> np.ndarray:
    """Most frequent class of each row; of equals the lowest."""
    return np.argmax((labels[:, :, None] == np.arange(CLASSES)).sum(axis=1), axis=1)


def static(c: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    mad = c["mad"][0]
    damped = lambda w: (p["scale"] * w // (p["scale"] + mad))[:, None]
    gdiv = np.where(p["grid"][:, None] == 0, c["gdiv_sim"], c["gdiv_other"])
    score = 256 * c["dot_px"] + 192 * c["dot_vg"] + damped(p["cent"]) * c["cent_sim"] + damped(p["prof"]) * c["prof_sim"] + damped(p["div"]) * c["div_sim"] + damped(p["gdiv"]) * gdiv
    tid, votes = (np.broadcast_to(c[k], score.shape) for k in ("tid", "votes"))
    order = np.lexsort((tid, -votes, -score), axis=1)[:, :3]
    return _majority(c["tlabel"][order])


def _evidence(c: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    j = np.arange(len(c["combined"]))
    return _div((c["combined"] + (c["div_sim"] + c["gdiv_sim"]) * p["topo"][:, None]) * p["decay"][:, None], p["decay"][:, None] + j)


def bayes(c: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    ev = _evidence(c, p) * (np.arange(len(c["combined"])) < p["first"][:, None])
    return np.argmax(ev @ (c["tlabel"][:, None] == np.arange(CLASSES)), axis=1)


def _recur(state: np.ndarray, c: dict[str, np.ndarray], p: dict[str, np.ndarray], begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    for j in range(len(c["combined"])):
        own = np.arange(CLASSES) == c["tlabel"][j]
        add = np.where(own, (_div(c["combined"][j], np.int64(256)) * p["gain"])[:, None], -p["penalty"][:, None])
        state = np.where(((begin <= j) & (j < end))[:, None], _div(state * p["inertia"][:, None] + add, p["inertia"][:, None] + 1), state)
    return state


def recurrent(c: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    zero = np.zeros((len(p["gain"]), CLASSES), np.int64)
    return np.argmax(_recur(zero, c, p, np.zeros_like(p["first"]), p["first"]), axis=1)


def pipeline(c: dict[str, np.ndarray], p: dict[str, np.ndarray]) -> np.ndarray:
    ev = _evidence(c, p) * (np.arange(len(c["combined"])) < p["first_a"][:, None])
    return np.argmax(_recur(ev @ (c["tlabel"][:, None] == np.arange(CLASSES)), c, p, p["first_a"], p["first_a"] + p["first_b"]), axis=1)
