"""Appending, remapping and comparing documents."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def append_blocks(target: DataFrame, source: DataFrame, by: str = "doc_id") -> DataFrame:
    """Blocks (by, ord, text) of target with source's after them, order numbers shifted by each target's last."""
    last = target.groupBy(by).agg(F.max("ord").alias("__last"))
    moved = source.join(last, by, "left").withColumn("ord", F.col("ord") + F.coalesce(F.col("__last") + 1, F.lit(0))).drop("__last")
    return target.unionByName(moved.select(target.columns))


def target_wins(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target's rows and those of source whose key (in any case) it doesn't have."""
    k = target.select(F.lower(key).alias("__k"))
    return target.unionByName(source.withColumn("__k", F.lower(key)).join(k, "__k", "left_anti").drop("__k").select(target.columns))


def fresh_ids(target: DataFrame, source: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """(by, old_id, new_id): source's ids from one above target's greatest, in order."""
    top = target.groupBy(*by).agg(F.max(id_col).alias("__top"))
    order = Window.partitionBy(*by).orderBy(id_col)
    ids = source.select(*by, id_col).distinct().withColumn("__n", F.row_number().over(order))
    return ids.join(top, by, "left").select(*by, F.col(id_col).alias("old_id"), (F.coalesce("__top", F.lit(0)) + F.col("__n")).alias("new_id"))


def based_on_chains(styles: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, style, chain): each style's ancestors from itself to its root, however many; a cycle is cut where it closes, and so is a
    chain whose next style is missing. The styles of a document (or, without by, all of them) are one map, so no join is repeated."""
    by = by or []
    known = styles.where("id is not null").groupBy(*by, "id").agg(F.min("based_on").alias("based_on"))
    maps = known.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("id", "based_on"))).alias("__m"))
    each = maps.select(*by, "__m", F.explode(F.map_keys("__m")).alias("style"))
    follow = lambda chain, _: F.when(
        F.map_contains_key("__m", F.coalesce(F.element_at("__m", F.element_at(chain, -1)), F.lit(""))) & ~F.array_contains(chain, F.coalesce(F.element_at("__m", F.element_at(chain, -1)), F.lit(""))),
        F.concat(chain, F.array(F.element_at("__m", F.element_at(chain, -1)))),
    ).otherwise(chain)
    return each.select(*by, "style", F.aggregate(F.sequence(F.lit(1), F.size("__m")), F.array("style"), follow).alias("chain"))


def middle_snake(a: list, a0: int, a1: int, b: list, b0: int, b1: int) -> tuple[int, int, int, int]:
    """(x, y, u, v): a run of equal items, maybe empty, in the middle of a shortest script of a[a0:a1] to b[b0:b1], met from both ends."""
    n, m = a1 - a0, b1 - b0
    delta, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            u = x
            while u < n and u - k < m and a[a0 + u] == b[b0 + u - k]:
                u += 1
            ahead[k] = u
            if odd and -d < delta - k < d and u + back[delta - k] >= n:
                return a0 + x, b0 + x - k, a0 + u, b0 + u - k
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            u = x
            while u < n and u - k < m and a[a1 - 1 - u] == b[b1 - 1 - u + k]:
                u += 1
            back[k] = u
            if not odd and -d <= delta - k <= d and u + ahead[delta - k] >= n:
                return a1 - u, b1 - u + k, a1 - x, b1 - x + k
    raise AssertionError("two walks meet")


def edit_script(a: list, b: list) -> list[tuple[str, object]]:
    """('same' | 'del' | 'ins', item): a shortest one, in O(ND) time and linear space (Myers), deletions before insertions."""
    out: list[tuple[str, object]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(("same", a[a0]))
            a0, b0 = a0 + 1, b0 + 1
        tail = 0
        while a0 < a1 - tail and b0 < b1 - tail and a[a1 - 1 - tail] == b[b1 - 1 - tail]:
            tail += 1
        if tail:  # its turn comes after what lies before it
            todo.append((a1 - tail, a1, b1 - tail, b1))
            a1, b1 = a1 - tail, b1 - tail
        if a0 == a1 or b0 == b1:
            out += [("del", x) for x in a[a0:a1]] + [("ins", x) for x in b[b0:b1]]
            continue
        x, y, u, v = middle_snake(a, a0, a1, b, b0, b1)
        todo += [(u, a1, v, b1), (x, u, y, v), (a0, x, b0, y)]
    # Within a change what goes stands before what comes.
    done: list[tuple[str, object]] = []
    change: list[tuple[str, object]] = []
    for step in [*out, ("same", None)]:
        if step[0] == "same":
            done += [s for s in change if s[0] == "del"] + [s for s in change if s[0] == "ins"] + [step]
            change = []
        else:
            change.append(step)
    return done[:-1]


def words(text: str) -> list[str]:
    return re.findall(r"\w+|\s+|[^\w\s]", text)


def compare_texts(original: list[str], revised: list[str]) -> list[tuple[int, int, str | None, str]]:
    """(para, seg, kind, text): paragraphs matched first, then changed neighbours word by word. The mark of a paragraph has kind mark-ins or mark-del."""
    out, para = [], 0
    script = edit_script(original, revised)
    i = 0
    while i < len(script):
        kind, text = script[i]
        if kind == "same":
            out.append((para, 0, None, text))
            i, para = i + 1, para + 1
            continue
        gone, new = [], []
        while i < len(script) and script[i][0] != "same":
            (gone if script[i][0] == "del" else new).append(script[i][1])
            i += 1
        for a, b in zip(gone, new, strict=False):
            seg, run = 0, []
            for k, w in edit_script(words(a), words(b)):
                if run and run[-1][0] == k:
                    run[-1][1] += w
                else:
                    run.append([k, w])
            for k, w in run:
                out.append((para, seg, None if k == "same" else k, w))
                seg += 1
            if not run:
                out.append((para, 0, None, ""))
            para += 1
        both = min(len(gone), len(new))
        for text, k in [(t, "del") for t in gone[both:]] + [(t, "ins") for t in new[both:]]:
            out += [(para, 0, k, text), (para, 1, f"mark-{k}", "")]
            para += 1
    return out


def compare(original: DataFrame, revised: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, para, seg, kind, text) for each document of either side (blocks by, ord, text); equal documents are settled by digest, without Python."""
    digest = lambda df: df.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]).alias("t"))
    both = digest(original).withColumnRenamed("t", "a").join(digest(revised).withColumnRenamed("t", "b"), by, "full")
    same = both.where(F.col("a") == F.col("b")).select(by, F.posexplode("a").alias("para", "text")).select(by, "para", F.lit(0).alias("seg"), F.lit(None).cast("string").alias("kind"), "text")
    changed = both.where(~F.col("a").eqNullSafe(F.col("b")))

    def run(batches):
        for pdf in batches:
            rows = [(d, *r) for d, a, b in zip(pdf[by], pdf["a"], pdf["b"], strict=True) for r in compare_texts([] if a is None else list(a), [] if b is None else list(b))]
            yield pd.DataFrame(rows, columns=[by, "para", "seg", "kind", "text"])

    return same.unionByName(changed.mapInPandas(run, f"{by} {original.schema[by].dataType.simpleString()}, para int, seg int, kind string, text string"))
