"""A quad-tree over places, built from counted cells, and an exact nearest search down its levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept

#: Levels of the finest cells, two at a time; levels counted in one pass.
DEPTH, STEP, PASS = 30, 2, 3
_SLACK = 1 + 1e-12


def real(*names: str) -> Column:
    """True where all these columns are finite numbers."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & (F.abs(F.col(n).cast("double")) < F.lit(float("inf")))
    return out


@dataclass(frozen=True)
class Tree:
    """cells: level, cx, cy, px, py (the parent), n, inner, x0, x1, y0, y1 (the box of its places), of all leaves and inner
    cells but the root; places: what was given, with level, cx, cy of its leaf. A leaf holds at most the bound of places unless
    it is one of the finest cells. left, low, size: the root's square."""

    cells: DataFrame
    places: DataFrame
    left: float
    low: float
    size: float
    levels: list[int]


def _at(level: int) -> tuple[Column, Column]:
    return F.shiftright("__ix", DEPTH - level), F.shiftright("__iy", DEPTH - level)


def build(places: DataFrame, bound: int = 64) -> Tree | None:
    """The tree of places (x, y and any other columns); None without any. Places must be finite and no two alike.

    Counting goes from the root down, PASS levels in a pass, and only cells that hold more than `bound` places are divided
    further, so the passes follow the density and no place is looked at again once its leaf is known. Counts are summed in each
    task before the exchange, so a dense cell is a row a task.
    """
    e = places.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d")).first()
    if e.a is None:
        return None
    size = max(e.b - e.a, e.d - e.c) or 1.0
    index = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / F.lit(size) * F.lit(float(1 << DEPTH))), F.lit((1 << DEPTH) - 1)).cast("long")
    live = places.withColumns({"__ix": index("x", e.a), "__iy": index("y", e.c)})
    cells, leaves, levels, level = [], [], [], 0
    while True:
        todo = [level + STEP * (i + 1) for i in range(PASS) if level + STEP * (i + 1) <= DEPTH]
        in_cells = live.withColumn("__c", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _at(k)[0].alias("cx"), _at(k)[1].alias("cy")) for k in todo]))).select("*", "__c.*").drop("__c")
        counted = in_cells.groupBy("level", "cx", "cy").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
        counted = kept(counted.withColumns({"inner": (F.col("n") > bound) & (F.col("level") < DEPTH), "px": F.shiftright("cx", STEP), "py": F.shiftright("cy", STEP)}), "tree-cells")
        parents = counted.where("inner").select((F.col("level") + STEP).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        real_cells = counted.where(F.col("level") == todo[0]).unionByName(counted.where(F.col("level") > todo[0]).join(parents, ["level", "px", "py"], "left_semi"))
        cells.append(real_cells)
        levels += todo
        leaves.append(kept(in_cells.join(real_cells.where("not inner").select("level", "cx", "cy"), ["level", "cx", "cy"]), "tree-places"))
        level = todo[-1]
        dense = real_cells.where(F.col("inner") & (F.col("level") == level)).select("cx", "cy")
        if not dense.head(1):
            break
        live = kept(in_cells.where(F.col("level") == level).join(dense, ["cx", "cy"], "left_semi").drop("level", "cx", "cy"), "tree-dense")
    union = lambda t: t[0] if len(t) == 1 else t[0].unionByName(union(t[1:]))
    return Tree(kept(union(cells), "tree-cells") if len(cells) > 1 else cells[0], union(leaves).drop("__ix", "__iy"), e.a, e.c, size, levels)


def _least(cell: str) -> Column:
    gap = lambda v, a, b: F.greatest(F.col(f"{cell}.{a}") - F.col(f"__k.{v}"), F.col(f"__k.{v}") - F.col(f"{cell}.{b}"), F.lit(0.0))
    return F.hypot(gap("x", "x0", "x1"), gap("y", "y0", "y1"))


def _most(cell: str) -> Column:
    far = lambda v, a, b: F.greatest(F.abs(F.col(f"__k.{v}") - F.col(f"{cell}.{a}")), F.abs(F.col(f"__k.{v}") - F.col(f"{cell}.{b}")))
    return F.hypot(far("x", "x0", "x1"), far("y", "y0", "y1"))


_CELL = ["level", "cx", "cy", "inner", "x0", "x1", "y0", "y1"]


def nearest_place(asked: DataFrame, tree: Tree) -> DataFrame:
    """asked (any columns with finite x and y, no two rows alike) with `near`, the struct of distance and the other columns of
    the tree's places: the nearest place, ties to the smallest of those columns."""
    best = candidates(asked, tree).groupBy("__q").agg(F.first("__k").alias("__k"), F.min("near").alias("near"))
    return best.select("__k.*", "near")


def candidates(asked: DataFrame, tree: Tree) -> DataFrame:
    """__q (a number for each row of asked), __k (the row) and `near` for every place of the leaves that may hold its nearest one.

    All rows go down the tree together, a level in a round. A row carries the cells that may hold its nearest place: those no
    farther than the least of the cells' greatest distances, since each cell holds a place. So a row meets some dozen cells and
    the places of a few leaves, however dense the places are somewhere.
    """
    first = tree.cells.where(F.col("level") == tree.levels[0]).select(*_CELL).collect()  # 16 cells at most
    struct = lambda values: F.struct(*[F.lit(v).alias(k) for k, v in zip(_CELL, values)])
    start = asked.select(F.monotonically_increasing_id().alias("__q"), F.struct(*[F.col(f"`{c}`") for c in asked.columns]).alias("__k"))
    start = kept(start, "tree-asked").withColumns({"__r": F.lit(float("inf")), "__leaves": F.array().cast("array<struct<level:int,cx:bigint,cy:bigint,least:double>>")})

    def pruned(met: DataFrame) -> DataFrame:
        """met: a row for each cell __c that a row comes to. What is too far is dropped before the exchange, then once more."""
        met = met.withColumns({"__least": _least("__c"), "__most": _most("__c")}).where(F.col("__c").isNull() | (F.col("__least") <= F.col("__r") * _SLACK))
        cell = F.struct(F.col("__c.level").cast("int").alias("level"), F.col("__c.cx").cast("long").alias("cx"), F.col("__c.cy").cast("long").alias("cy"), F.col("__least").alias("least"))
        t = met.groupBy("__q").agg(
            F.first("__k").alias("__k"), F.least(F.min("__r"), F.min("__most")).alias("__r"), F.first("__leaves").alias("__leaves"),
            F.collect_list(F.when(~F.col("__c.inner"), cell)).alias("__new"), F.collect_list(F.when(F.col("__c.inner"), cell)).alias("__front"),
        )
        near = lambda c: F.filter(c, lambda x: x["least"] <= F.col("__r") * _SLACK)
        return t.select("__q", "__k", "__r", near(F.concat("__leaves", "__new")).alias("__leaves"), near("__front").alias("__front"))

    state, done = kept(pruned(start.withColumn("__c", F.explode(F.array(*[struct(c) for c in first])))), "tree-search"), []
    children = tree.cells.select((F.col("level") - STEP).cast("int").alias("__l"), F.col("px").alias("__x"), F.col("py").alias("__y"), F.struct(*_CELL).alias("__c"))
    while True:
        done.append(state.where(F.size("__front") == 0).drop("__front"))
        going = state.where(F.size("__front") > 0)
        if not going.head(1):
            break
        into = going.withColumn("__p", F.explode("__front")).drop("__front").withColumns({"__l": F.col("__p.level"), "__x": F.col("__p.cx"), "__y": F.col("__p.cy")}).drop("__p")
        met = into.join(children, ["__l", "__x", "__y"]).drop("__l", "__x", "__y")
        alone = going.drop("__front").withColumn("__c", F.lit(None).cast(met.schema["__c"].dataType))  # keeps a row whose cells are all too far
        state = kept(pruned(met.unionByName(alone)), "tree-search")
    reached = done[0]
    for t in done[1:]:
        reached = reached.unionByName(t)
    inside = [c for c in tree.places.columns if c not in ("level", "cx", "cy", "x", "y")]
    places = tree.places.select("level", "cx", "cy", F.col("x").alias("__tx"), F.col("y").alias("__ty"), F.struct(*inside).alias("__place"))
    pairs = reached.select("__q", "__k", F.explode("__leaves").alias("__c")).select("__q", "__k", "__c.level", "__c.cx", "__c.cy").join(places, ["level", "cx", "cy"])
    near = F.struct(F.hypot(F.col("__k.x") - F.col("__tx"), F.col("__k.y") - F.col("__ty")).alias("distance"), *[F.col(f"__place.{c}").alias(c) for c in inside])
    return pairs.select("__q", "__k", near.alias("near"))


def with_margins(tree: Tree, share: float, bound: int) -> DataFrame:
    """The places of each leaf, `own`, and those around it, not own, that lie within `share` (at most 1/2) of the leaf's side: level,
    cx, cy, own, whole and the places' columns. `whole`: the leaf has all of its margin; a leaf with more than `bound` places in
    its margin has none of them."""
    leaves = tree.cells.where("not inner").select("level", "cx", "cy")
    unit = lambda c, low: (F.col(c) - F.lit(low)) / F.lit(tree.size)
    keys = []
    for level in tree.levels:
        at = lambda c, low, d, n=float(1 << level): F.least(F.floor(unit(c, low) * n + d), F.lit((1 << level) - 1)).cast("long")
        keys += [F.struct(F.lit(level).alias("level"), at("x", tree.left, dx).alias("cx"), at("y", tree.low, dy).alias("cy")) for dx in (-share, share) for dy in (-share, share)]
    inside = [c for c in tree.places.columns if c not in ("level", "cx", "cy")]
    home = F.struct("level", "cx", "cy")
    margin = tree.places.withColumn("__home", home).withColumn("__at", F.explode(F.array_distinct(F.array(*keys)))).where(F.col("__at") != F.col("__home"))
    margin = kept(margin.select("__at.*", *inside).join(leaves, ["level", "cx", "cy"]), "tree-margins")
    full = margin.groupBy("level", "cx", "cy").agg(F.count("*").alias("__n")).where(F.col("__n") > bound).select("level", "cx", "cy", F.lit(True).alias("__full"))
    # The mark goes to the leaf's own places too, so a leaf knows whether its margin is whole.
    marked = tree.places.join(full, ["level", "cx", "cy"], "left")
    own = marked.select("level", "cx", "cy", *inside, F.lit(True).alias("own"), F.col("__full").isNull().alias("whole"))
    return own.unionByName(margin.join(full, ["level", "cx", "cy"], "left_anti").select("level", "cx", "cy", *inside, F.lit(False).alias("own"), F.lit(True).alias("whole")))
