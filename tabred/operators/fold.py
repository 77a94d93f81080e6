"""De-normalise along a subset of the eight references, and rebuild the tables from the result."""
from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabred.schemas import KEYS, REFERENCE_BY_CODE, REFERENCES, TABLE_OF, TBL_SCHEMAS, Reference, mask_codes
from tabred.session import checkpointed, written

Tables = dict[str, DataFrame]
COLUMNS = {code: tuple(TBL_SCHEMAS[name].names) for code, name in TABLE_OF.items()}


def digest(columns: list[str] | tuple[str, ...]) -> Column:
    """64 bits of the columns' values and of which of them are null. Only rows of one key are told apart by it."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def digest_name(table: str) -> str:
    return f"{table.lower()}_digest"


def digest_columns(table: str, kept: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Keys, references and ``kept`` columns of a table, and the digest that stands for the others."""
    named = {*KEYS[table], *kept, *[f for r in REFERENCES if r.source == table for f in r.fields]}
    return (*[c for c in COLUMNS[table] if c in named], digest_name(table))


def digested(t: Tables, kept: tuple[str, ...] = ()) -> Tables:
    """The tables with :func:`digest_columns`, so that flat rows made of them stay narrow."""
    def made(table: str) -> DataFrame:
        named = digest_columns(table, kept)
        others = [c for c in COLUMNS[table] if c not in named]
        return t[TABLE_OF[table]].select(*named[:-1], (digest(others) if others else F.lit(0).cast("long")).alias(named[-1]))
    return {name: made(table) for table, name in TABLE_OF.items()}


Path = tuple[str, ...]
# Slices of a parent's children where edges move to them, at least, and children of a slice over all parents, about.
SLICES, SLICE_ROWS = 64, 4096


@dataclass(frozen=True)
class Layout:
    """Columns of the flat rows of ``root``. A place in them is the path of references that leads to it.

    A key that a reference already holds is not kept again: such a column is the reference's own. Any other column
    has its own name, with the place behind it (fixed form of output names) where a table is reached more than once.
    """
    root: str
    codes: tuple[str, ...]
    columns: tuple[tuple[str, tuple[str, ...]], ...] = tuple(COLUMNS.items())

    @cached_property
    def paths(self) -> list[Path]:
        """All places, nearer ones first."""
        found, level = [], [()]
        while level:
            found += level
            level = [(*path, code) for path in level for code in self.codes if REFERENCE_BY_CODE[code].source == self.end(path)]
        return found

    @cached_property
    def repeated(self) -> set[str]:
        ends = [self.end(p) for p in self.paths]
        return {t for t in ends if ends.count(t) > 1}

    def end(self, path: Path) -> str:
        return REFERENCE_BY_CODE[path[-1]].target if path else self.root

    def token(self, path: Path) -> str:
        return "__".join((self.end(path), *path))

    def by_reference(self, path: Path) -> dict[str, str]:
        """Key columns at a place, and the columns one place before that refer to them."""
        return dict(zip(KEYS[self.end(path)], REFERENCE_BY_CODE[path[-1]].fields)) if path else {}

    def column(self, path: Path, name: str) -> str:
        """Flat column that holds a column of the table at a place."""
        while name in (held := self.by_reference(path)):
            path, name = path[:-1], held[name]
        return f"{name}__{self.token(path).lower()}" if self.end(path) in self.repeated else name

    def stored(self, path: Path) -> dict[str, str]:
        """Columns kept at a place, with their flat names."""
        return {c: self.column(path, c) for c in dict(self.columns)[self.end(path)] if c not in self.by_reference(path)}

    def keys(self, path: Path) -> list[str]:
        return [self.column(path, k) for k in KEYS[self.end(path)]]

    def places(self, table: str) -> list[Path]:
        return [p for p in self.paths if self.end(p) == table]

    def open_references(self) -> list[tuple[Reference, list[str]]]:
        """References that are not folded, with the flat columns that hold them, place by place."""
        return [(r, [self.column(p, f) for f in r.fields]) for p in self.paths for r in REFERENCES
                if r.source == self.end(p) and r.code not in self.codes]


def roots(codes: tuple[str, ...]) -> list[str]:
    """Tables that stay tables: not all references to them are folded, or there are none."""
    folded = Counter(REFERENCE_BY_CODE[c].target for c in codes)
    every = Counter(r.target for r in REFERENCES)
    return [t for t in TABLE_OF if not every[t] or folded[t] < every[t]]


def _same(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [x == y for x, y in pairs])


def fold_root(t: Tables, root: str, codes: tuple[str, ...], layout: Layout | None = None) -> DataFrame:
    """Flat rows of one root. A parent takes in its own parents first, so each row is shuffled once per level."""
    layout = layout or Layout(root, codes)

    def build(path: Path) -> DataFrame:
        held = {k: f"_{layout.token(path)}_{k}" for k in layout.by_reference(path)}
        names = {**layout.stored(path), **held}
        frame = t[TABLE_OF[layout.end(path)]].select(*[F.col(c).alias(name) for c, name in names.items()])
        for further in (p for p in layout.paths if p[:-1] == path and p):
            parent, link = build(further), layout.by_reference(further)
            keys = {k: f"_{layout.token(further)}_{k}" for k in link}
            frame = frame.join(parent, _same([(frame[names[f]], parent[keys[k]]) for k, f in link.items()])).drop(*keys.values())
        return frame

    return build(())


def fold(t: Tables, mask: int) -> dict[str, DataFrame]:
    """One frame per root: flat where the mask folds a reference of the root, else the table itself."""
    codes = mask_codes(mask)
    return {r: fold_root(t, r, codes) for r in roots(codes)}


def folded_roots(codes: tuple[str, ...]) -> list[str]:
    return [r for r in roots(codes) if any(x.source == r and x.code in codes for x in REFERENCES)]


def row_text(columns: list[str] | tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in columns])


def fold_lineage(t: Tables, mask: int) -> DataFrame:
    """For every flat row the key of each source row it copies: [root, row_key, token, source_key]."""
    codes, parts = mask_codes(mask), []
    for root in folded_roots(codes):
        layout = Layout(root, codes)
        sources = F.array(*[F.struct(F.lit(layout.token(p)).alias("token"), row_text(layout.keys(p)).alias("source_key")) for p in layout.paths])
        parts.append(fold_root(t, root, codes).select(
            F.lit(root).alias("root"), row_text(layout.keys(())).alias("row_key"), F.inline(sources)))
    return reduce(DataFrame.unionAll, parts)


def inherited_edges(t: Tables, mask: int) -> DataFrame:
    """Edges of the folded schema: every copy of a source row carries its references that are not folded.

    The target key is read from the flat row, so no join with an edge table is needed.
    """
    codes, parts = mask_codes(mask), []
    for root in roots(codes):
        frame = fold_root(t, root, codes)
        for ref, target in Layout(root, codes).open_references():
            parts.append(frame.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in target])).select(
                F.lit(ref.code).alias("type"), F.lit(root).alias("source_root"), row_text(KEYS[root]).alias("source_key"),
                F.lit(ref.target).alias("target_root"), row_text(target).alias("target_key")))
    return reduce(DataFrame.unionAll, parts)


def unfold(folds: dict[str, DataFrame], mask: int) -> dict[str, DataFrame]:
    """Rebuild the tables that are no longer stored as such from flat rows alone: one row per key."""
    codes = mask_codes(mask)
    retained = set(roots(codes)) - set(folded_roots(codes))
    found: dict[str, list[DataFrame]] = {}
    for root in folded_roots(codes):
        layout = Layout(root, codes)
        for path in (p for p in layout.paths if layout.end(p) not in retained):
            table = layout.end(path)
            found.setdefault(table, []).append(folds[root].select(*[F.col(layout.column(path, c)).alias(c) for c in COLUMNS[table]]))
    return {table: reduce(DataFrame.unionByName, frames).dropDuplicates(list(KEYS[table]))
            for table, frames in found.items()}


def rebuilt_edges(tables: dict[str, DataFrame]) -> DataFrame:
    """Edges between rebuilt tables, by key."""
    parts = []
    for ref in REFERENCES:
        if ref.source in tables and ref.target in tables:
            child, parent = tables[ref.source], tables[ref.target]
            link = _same([(child[f], parent[k]) for f, k in zip(ref.fields, KEYS[ref.target])])
            parts.append(child.join(parent.select(*KEYS[ref.target]), link, "left_semi").select(
                F.lit(ref.code).alias("type"), row_text(KEYS[ref.source]).alias("source_key"), row_text(ref.fields).alias("target_key")))
    return reduce(DataFrame.unionAll, parts)


def participants(t: Tables, layout: Layout, path: Path) -> DataFrame:
    """Source rows that reach a fold at this place: those that a participating child references."""
    table = layout.end(path)
    frame = t[TABLE_OF[table]].select(*dict(layout.columns)[table])
    if not path:
        return frame
    link = layout.by_reference(path)
    child = participants(t, layout, path[:-1]).select(*[F.col(f).alias(f"_c_{f}") for f in link.values()])
    return frame.join(child, _same([(F.col(k), F.col(f"_c_{f}")) for k, f in link.items()]), "left_semi")


def narrow_layout(root: str, codes: tuple[str, ...], kept: tuple[str, ...] = ()) -> Layout:
    """Layout of flat rows of :func:`digested` tables."""
    return Layout(root, codes, tuple((c, digest_columns(c, kept)) for c in TABLE_OF))


def check_lossless(t: Tables, mask: int) -> DataFrame:
    """Per rebuilt table: rows that differ from the participating source rows; all zero when lossless.

    Keys and references go through fold and rebuilding as they are, the other columns of a row as one digest. Both
    sides have one row per key, so they meet in one aggregation by key: a key of one side counts once, a key with two
    different rows twice.
    """
    codes, narrow = mask_codes(mask), digested(t)
    kept = set(roots(codes)) - set(folded_roots(codes))
    sides: dict[str, list[DataFrame]] = {}
    none = F.lit(None).cast("long")
    for root in folded_roots(codes):
        layout = narrow_layout(root, codes)
        flat = written(fold_root(narrow, root, codes, layout))
        for path in (p for p in layout.paths if layout.end(p) not in kept):
            table = layout.end(path)
            names, keys = digest_columns(table), KEYS[table]
            rebuilt = flat.select(*[F.col(layout.column(path, c)).alias(c) for c in names])
            source = participants(narrow, layout, path)
            sides.setdefault(table, []).extend([rebuilt.select(*keys, digest(names).alias("_is"), none.alias("_was")),
                                                source.select(*keys, none.alias("_is"), digest(names).alias("_was"))])
    parts = []
    for table, frames in sides.items():
        both = reduce(DataFrame.unionAll, frames).groupBy(*KEYS[table]).agg(F.min("_is").alias("_is"), F.min("_was").alias("_was"))
        wrong = F.when(F.col("_is").isNull() | F.col("_was").isNull(), 1).when(F.col("_is") != F.col("_was"), 2).otherwise(0)
        parts.append(both.agg(F.coalesce(F.sum(wrong), F.lit(0)).cast("long").alias("differing")).select(F.lit(table).alias("table"), "differing"))
    return reduce(DataFrame.unionAll, parts)


def count_cells(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: rows and non-null cells, in one pass."""
    columns = columns or frame.columns
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("long") for c in columns])
    return frame.agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum(filled), F.lit(0)).alias("cells"))


def _sums(t: Tables, root: str, codes: tuple[str, ...]) -> DataFrame:
    """Keys of the rows of ``root`` that make flat rows, and the filled cells and open edges that each brings with it."""
    refs = [r for r in REFERENCES if r.source == root]
    whole = lambda r: reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in r.fields]).cast("int")
    frame = t[TABLE_OF[root]].select(
        *[F.col(k).alias(f"_k_{k}") for k in KEYS[root]], *[F.col(f).alias(f"_f_{f}") for r in refs if r.code in codes for f in r.fields],
        _filled(KEYS[root]).alias("_keys"), _filled([c for c in COLUMNS[root] if c not in KEYS[root]]).alias("_cells"),
        reduce(lambda a, b: a + b, [whole(r) for r in refs if r.code not in codes], F.lit(0)).alias("_edges"))
    for r in (r for r in refs if r.code in codes):
        parent = _sums(t, r.target, codes).select(
            *[F.col(f"_k_{k}").alias(f"_p_{k}") for k in KEYS[r.target]], F.col("_cells").alias("_p_cells"), F.col("_edges").alias("_p_edges"))
        link = _same([(F.col(f"_f_{f}"), F.col(f"_p_{k}")) for f, k in zip(r.fields, KEYS[r.target])])
        frame = frame.join(parent, link).withColumns({x: F.col(x) + F.col(f"_p{x}") for x in ("_cells", "_edges")}).drop(*parent.columns)
    return frame


def structural_delta(t: Tables, mask: int) -> DataFrame:
    """Rows, edges and non-null cells of the folded schema minus the normalised one.

    What a row adds to flat rows is two numbers, which the tables hand up along the references of the mask.
    """
    codes = mask_codes(mask)
    folded = folded_roots(codes)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sides = []
    for root in roots(codes):
        made = _sums(t, root, codes if root in folded else ()).agg(
            F.count(F.lit(1)).alias("nodes"), total(F.col("_edges")).alias("edges"), total(F.col("_keys") + F.col("_cells")).alias("cells"))
        sides.append(made if root in folded else made.select(F.lit(0).cast("long").alias("nodes"), "edges", F.lit(0).cast("long").alias("cells")))
    for code in TABLE_OF:
        moved = code in folded or code not in roots(codes)
        made = _sums(t, code, ()).agg(F.count(F.lit(1)).alias("nodes"), total(F.col("_edges")).alias("edges"), total(F.col("_keys") + F.col("_cells")).alias("cells"))
        kept = F.lit(1 if moved else 0).cast("long")
        sides.append(made.select((-F.col("nodes") * kept).alias("nodes"), (-F.col("edges")).alias("edges"), (-F.col("cells") * kept).alias("cells")))
    return (reduce(DataFrame.unionAll, sides)
            .agg(*[F.sum(x).alias(f"delta_{x}") for x in ("nodes", "edges", "cells")])
            .select(F.lit(mask).alias("mask"), "delta_nodes", "delta_edges", "delta_cells"))


def structural_deltas(t: Tables, masks: list[int]) -> DataFrame:
    return reduce(DataFrame.unionAll, [structural_delta(t, m) for m in masks])


def _bits(codes) -> int:
    return sum(1 << i for i, r in enumerate(REFERENCES) if r.code in codes)


EVERY = tuple(r.code for r in REFERENCES)


def reach(root: str) -> int:
    """Mask of the references that a fold of ``root`` can follow."""
    return _bits({code for path in Layout(root, EVERY).paths for code in path})


def _mark(path: Path, what: str) -> str:
    return "__".join((what, *path))


def _filled(columns) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns], F.lit(0))


def _profiles(t: Tables, root: str, handed: dict[str, DataFrame], named: str | None) -> DataFrame:
    """Key of every row of ``root``, and per place that it can reach the filled cells and which references are filled.

    The table is read once and takes in the profiles of the tables that it refers to: a few small numbers per row,
    and of their columns only the keys of the table ``named``. Numbers of places that a row does not reach are null.
    Keys must be unique.
    """
    refs = [r for r in REFERENCES if r.source == root]
    own = [c for c in COLUMNS[root] if c not in KEYS[root]]
    fields = list(dict.fromkeys(f for r in refs for f in r.fields))
    whole = lambda r: reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in r.fields]).cast("int")
    frame = t[TABLE_OF[root]].select(
        *[F.col(k).alias(f"_k_{k}") for k in KEYS[root]], *[F.col(f).alias(f"_f_{f}") for f in fields], _filled(own).alias(_mark((), "cells")),
        *[F.col(k).alias(_mark((), k)) for k in KEYS[root] if root == named],
        _filled(KEYS[root]).alias("_keys"), *[whole(r).alias(_mark((r.code,), "edge")) for r in refs])
    for r in refs:
        places = [c for c in handed[r.target].columns if not c.startswith("_")]
        parent = handed[r.target].select(
            *[F.col(f"_k_{k}").alias(f"_{r.code}_{k}") for k in KEYS[r.target]],
            *[F.col(c).alias("__".join((c.split("__")[0], r.code, *c.split("__")[1:]))) for c in places])
        link = _same([(F.col(f"_f_{f}"), F.col(f"_{r.code}_{k}")) for f, k in zip(r.fields, KEYS[r.target])])
        frame = frame.join(parent, link, "left").drop(*[f"_{r.code}_{k}" for k in KEYS[r.target]])
    return frame.drop(*[f"_f_{f}" for f in fields])


def _handed_up(t: Tables, named: str | None = None) -> dict[str, DataFrame]:
    """Profiles of all tables, from region to lineitem; those that others take in are written once."""
    handed: dict[str, DataFrame] = {}
    while len(handed) < len(TABLE_OF):
        for root in TABLE_OF:
            if root not in handed and all(r.target in handed for r in REFERENCES if r.source == root):
                made = _profiles(t, root, handed, named)
                handed[root] = checkpointed(made) if any(r.target == root for r in REFERENCES) else made
    return handed


def _follows(codes) -> Column:
    """Whether the references are among those of the column ``way``."""
    return F.col("way").bitwiseAND(F.lit(_bits(codes))) == F.lit(_bits(codes))


def _in_all_ways(profiles: DataFrame, root: str) -> DataFrame:
    """Different profiles with their rows ``n``, for every subset ``way`` of the references that ``root`` can follow, where such rows make flat rows.

    Rows of equal profiles are counted first, so only the different profiles, not the rows, meet the subsets.
    """
    counted = profiles.groupBy(*[c for c in profiles.columns if not c.startswith("_k_")]).agg(F.count(F.lit(1)).alias("n"))
    ways = sorted({m & reach(root) for m in range(1 << len(REFERENCES))})
    met = [~_follows(p) | F.col(_mark(p, "cells")).isNotNull() for p in Layout(root, EVERY).paths]
    return counted.withColumn("way", F.explode(F.array(*[F.lit(w) for w in ways]))).where(reduce(lambda a, b: a & b, met))


def _ways(profiles: DataFrame, root: str) -> DataFrame:
    """[root, way, nodes, edges, cells] of the flat rows of ``root`` for every subset of the references it can follow."""
    layout = Layout(root, EVERY)
    cells = [F.when(_follows(p), F.col(_mark(p, "cells"))).otherwise(0) for p in layout.paths]
    edges = [F.when(_follows(p) & ~_follows((r.code,)), F.col(_mark((*p, r.code), "edge"))).otherwise(0)
             for p in layout.paths for r in REFERENCES if r.source == layout.end(p)]
    total = lambda xs: F.sum(F.col("n") * reduce(lambda a, b: a + b, xs, F.lit(0)))
    return (_in_all_ways(profiles, root).groupBy("way")
            .agg(F.sum("n").alias("nodes"), total(edges).alias("edges"), total([F.col("_keys"), *cells]).alias("cells"))
            .select(F.lit(root).alias("root"), "way", "nodes", "edges", "cells"))


def _of_masks(totals: DataFrame) -> DataFrame:
    """[root, way, ...] for every mask, marked by ``folds``: whether the mask keeps this root and folds it this way."""
    into = {c: _bits({r.code for r in REFERENCES if r.target == c}) for c in TABLE_OF}
    of_root = lambda of: F.create_map(*[F.lit(x) for c in TABLE_OF for x in (c, of(c))])[F.col("root")]
    every = totals.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << len(REFERENCES)) - 1))))
    stays = (of_root(into.get) == 0) | (F.col("mask").bitwiseAND(of_root(into.get)) != of_root(into.get))
    return every.withColumn("folds", stays & (F.col("mask").bitwiseAND(of_root(reach)) == F.col("way")))


def all_structural_deltas(t: Tables) -> DataFrame:
    """:func:`structural_delta` of all 256 masks, with each table read once and no flat row made.

    What a table can add to flat rows is handed up along the references, from region to lineitem. A mask's folded
    schema is its roots, each folded along the references of the mask that it can follow, and the normalised schema is
    every table folded along none, so that both are sums over the same totals. Empty and dangling references make no
    flat row; empty tables give zeros.
    """
    totals = reduce(DataFrame.unionAll, [_ways(made, root) for root, made in _handed_up(t).items()])
    sign = F.col("folds").cast("int") - (F.col("way") == 0).cast("int")
    sums = _of_masks(totals).groupBy("mask").agg(*[F.sum(sign * F.col(x)).alias(f"delta_{x}") for x in ("nodes", "edges", "cells")])
    numbers = t["region"].sparkSession.range(1 << len(REFERENCES)).select(F.col("id").cast("int").alias("mask"))
    return numbers.join(sums, "mask", "left").select("mask", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in sums.columns[1:]])


def all_copies_per_key(t: Tables, table: str) -> DataFrame:
    """:func:`copies_per_key` of all 256 masks, with each table read once: [mask, key..., copies]; keys without copies have no row.

    Only the keys of ``table`` are handed up with the profiles; rows are counted per key before they meet the masks.
    """
    keys, parts = list(KEYS[table]), []
    for root, made in _handed_up(t, table).items():
        own = [r.code for r in REFERENCES if r.source == root]
        for path in Layout(root, EVERY).places(table):
            folded = reduce(lambda a, b: a | b, [_follows((c,)) for c in own], F.lit(False))
            parts.append(_in_all_ways(made, root).where(folded & _follows(path)).groupBy(
                F.lit(root).alias("root"), "way", *[F.col(_mark(path, k)).alias(k) for k in keys]).agg(F.sum("n").alias("copies")))
    return (_of_masks(reduce(DataFrame.unionAll, parts)).where("folds").groupBy("mask", *keys).agg(F.sum("copies").alias("copies")))


def copies_per_key(t: Tables, mask: int, table: str) -> DataFrame:
    """How many flat rows hold each row of ``table``, over all its places: [key..., copies]."""
    codes, parts = mask_codes(mask), []
    for root in folded_roots(codes):
        layout = Layout(root, codes)
        for path in layout.places(table):
            parts.append(fold_root(t, root, codes).groupBy(
                *[F.col(layout.column(path, k)).alias(k) for k in KEYS[table]]).agg(F.count(F.lit(1)).alias("copies")))
    return reduce(DataFrame.unionAll, parts).groupBy(*KEYS[table]).agg(F.sum("copies").alias("copies"))


# -- one reference of any schema ------------------------------------------------------------------

def fold_edge(child: DataFrame, parent: DataFrame, fields: list[str], parent_key: list[str]) -> DataFrame:
    """Fold a parent into its children; parent columns that clash with the child get ``parent_``."""
    names = {c: f"parent_{c}" if c in child.columns else c for c in parent.columns if c not in parent_key}
    side = parent.select(*[F.col(k).alias(f"_pk_{k}") for k in parent_key], *[F.col(c).alias(o) for c, o in names.items()])
    return (child.join(side, _same([(child[f], side[f"_pk_{k}"]) for f, k in zip(fields, parent_key)]))
            .drop(*[f"_pk_{k}" for k in parent_key]))


def rewire_edges(edges: DataFrame, pairs: DataFrame, child_label: str, parent_label: str, folded_label: str,
                 folded_type: str) -> DataFrame:
    """Move the edges of a folded pair to the flat rows.

    ``edges``: [type, src_label, src, dst_label, dst]; ``pairs``: [child, parent], one row per flat row,
    which keeps the child's key. Edges of the parent go to every flat row of that parent.
    """
    kept = edges.where(F.col("type") != folded_type)
    # Parents are few and have many children: a parent's children are met slice by slice, by many tasks, and a slice as
    # one list, so that rows are made by going through lists and not by the join. Spark would take the edges for few,
    # as it does not count their copies per slice, and a broadcast of them would leave all rows to one or two tasks.
    count = max(SLICES, -(-pairs.count() // SLICE_ROWS))
    sliced = pairs.groupBy(F.col("parent").alias("_old"), F.pmod(F.xxhash64("child"), F.lit(count)).alias("_slice")).agg(
        F.collect_list(F.struct(F.col("child").alias("_new"))).alias("_children"))
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def moved(frame: DataFrame, end: str) -> DataFrame:
        label = F.col(f"{end}_label")
        children = frame.where(label == child_label).join(pairs.select(F.col("child").alias("_new")), F.col(end) == F.col("_new"))
        parents = frame.where(label == parent_label).withColumn("_part", slices).repartition(count, end, "_part").join(
            sliced.hint("merge"), (F.col(end) == F.col("_old")) & (F.col("_part") == F.col("_slice"))).select(*frame.columns, F.inline("_children"))
        hits = [h.withColumns({f"{end}_label": F.lit(folded_label), end: F.col("_new")}).select(*frame.columns) for h in (children, parents)]
        return reduce(DataFrame.unionByName, hits, frame.where(~label.isin(child_label, parent_label)))

    return moved(moved(kept, "src"), "dst").where((F.col("src_label") == folded_label) | (F.col("dst_label") == folded_label))


# -- splitting ------------------------------------------------------------------------------------

def split_by_reference(nodes: DataFrame, edges: DataFrame, dependent: str, label: str) -> DataFrame:
    """Dependent values that all filled rows of a target agree on, kept once per target.

    ``nodes``: [id, dependent]; ``edges``: [src, dst]. Only rows with exactly one edge and a filled
    dependent count; a target needs two of them.
    """
    single = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("dst")).where(F.col("n") == 1)
    return (nodes.withColumn(dependent, F.col(dependent).cast("string")).where(F.col(dependent) != "")
            .join(single, F.col("id") == F.col("src"))
            .groupBy("dst").agg(F.count(F.lit(1)).alias("fanout"), F.min(dependent).alias("low"), F.max(dependent).alias("high"))
            .where((F.col("fanout") >= 2) & (F.col("low") == F.col("high")))
            .select("dst", F.col("low").alias(f"{dependent}_{label}"), "fanout"))
