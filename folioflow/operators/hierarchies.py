"""What depends on a chain of rows: ancestors, inherited properties, nested numbers, replayed edits, names that must be free."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import joins as j
from folioflow.operators import windows as w
from folioflow.session import Kept


def with_ancestors(touched: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """The units of ``touched`` and all that they stand in, through any number of levels; (key).

    ``parents`` has (key, parent) rows; a unit may have several parents, and rings are no
    harm. Each round doubles the reach: what was found joins the pointers of 2 ** n
    levels, which join themselves. Both are written tables, so no plan grows, and there are as many
    rounds as the logarithm of the deepest chain: a round that finds nothing new ends it, as then no parent of a found unit is missing.
    """
    work = Kept(touched.sparkSession, "ancestors")
    found = work.keep(touched.select(F.col(key).alias("k")).where("k is not null").distinct(), "found-0")
    jump = work.keep(parents.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("k is not null and p is not null and k <> p").distinct(), "jump-0")
    n, count = 0, found.count()
    while True:
        wider = work.keep(found.union(found.join(jump, "k").select("p")).distinct(), f"found-{n + 1}")
        new = wider.count()
        if new == count:
            work.drop(f"found-{n}", f"jump-{n}")
            return wider.select(F.col("k").alias(key))
        further = jump.join(jump.select(F.col("k").alias("p"), F.col("p").alias("q")), "p").select("k", F.col("q").alias("p")).distinct()
        jump = work.keep(further, f"jump-{n + 1}")
        work.drop(f"found-{n}", f"jump-{n}")
        found, count, n = wider, new, n + 1


def inherited(styles: DataFrame, keys: list[str], key: str, parent: str, properties: list[str]) -> DataFrame:
    """(keys, key, properties) with each null property from the nearest style that it is based on and that has one.

    A style is based on one other of the same ``keys``, or on none; a parent that is not there ends the
    chain, and a chain that runs into a ring ends where it would come round. Rounds double
    the stretch of the chain that a row has seen, through written tables; when the stretch is as long as the
    largest group, every chain has been seen whole.
    """
    work = Kept(styles.sparkSession, "inherited")
    rows = work.keep(styles.select(*keys, F.col(key).alias("_key"), F.col(parent).alias("_next"), *properties), "0")
    largest = rows.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0
    n, seen = 0, 1
    while seen < largest and not rows.where("_next is not null").isEmpty():
        far = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_key").alias("_of"), F.col("_next").alias("_after"), *(F.col(p).alias(f"_{p}") for p in properties))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = rows.join(far, [*same, F.col("_next") == F.col("_of")], "left")
        rows = work.keep(joined.select(*keys, "_key", F.col("_after").alias("_next"), *(F.coalesce(p, f"_{p}").alias(p) for p in properties)), f"{n + 1}")
        work.drop(str(n))
        n, seen = n + 1, 2 * seen
    return rows.select(*keys, F.col("_key").alias(key), *properties)


def _numbered(state, row):
    """Counts of the open levels: {level: (count, ordered)}; a skipped level has none."""
    listed, level, ordered, place = row
    if not listed:
        return {}, [(place, None)]
    level, ordered = max(level or 0, 0), bool(ordered)
    count, was = state.get(level, (0, ordered))
    count = count + 1 if was == ordered else 1
    return {**{k: v for k, v in state.items() if k < level}, level: (count, ordered)}, [(place, count)]


def nested_numbers(blocks: DataFrame, keys: list[str], order: str, listed: str, level: str, ordered: str) -> DataFrame:
    """(keys, order, number) of every block: an item's number in its level, null for other blocks.

    An item ends all deeper lists; a change between ordered and not starts its level anew, and so does any other block.
    """
    rows = blocks.select(*keys, F.col(listed).alias("_listed"), F.col(level).cast("int").alias("_level"), F.col(ordered).alias("_ordered"), F.col(order).alias("_place"))
    kind = blocks.schema[order].dataType.simpleString()
    return w.folded(rows, keys, ["_place"], {}, _numbered, f"_at {kind}, number int").withColumnRenamed("_at", order)


def replayed(events: DataFrame, keys: list[str], order: list[str], event: str, kind: str, most: int = 20) -> DataFrame:
    """(keys, event, applied, shown, undos, redos) after each event of kind edit, undo or redo.

    ``shown`` is the edit whose result the document shows, null for the original. An edit
    keeps what was shown before, the last ``most`` of these, and ends all redos; undo and redo go
    back and forth, and do nothing where there is nothing. Other kinds do nothing. A task holds
    one document's two short stacks while it streams its events.
    """

    def step(state, row):
        *_, what, which = row
        shown, undos, redos = state
        applied = what == "edit" or (what == "undo" and bool(undos)) or (what == "redo" and bool(redos))
        if what == "edit":
            shown, undos, redos = which, (*undos, shown)[-most:], ()
        elif applied and what == "undo":
            shown, undos, redos = undos[-1], undos[:-1], (*redos, shown)
        elif applied:
            shown, undos, redos = redos[-1], (*undos, shown), redos[:-1]
        return (shown, undos, redos), [(which, applied, shown, len(undos), len(redos))]

    named = [f"_o{n}" for n in range(len(order))]
    rows = events.select(*keys, *(F.col(c).alias(n) for c, n in zip(order, named)), F.col(kind).alias("_kind"), F.col(event).alias("_event"))
    of = events.schema[event].dataType.simpleString()
    return w.folded(rows, keys, named, (None, (), ()), step, f"_e {of}, applied boolean, shown {of}, undos int, redos int").withColumnRenamed("_e", event)


_NUMBERS = r"( \(\d+\))*$"


def free_names(names: DataFrame, keys: list[str], name: str, order: str, existing: DataFrame | None = None) -> DataFrame:
    """(keys, order, unique_name): in order, each its own name or the first free of ``name (2)``, ``name (3)`` before the extension.

    Free is what neither stands in the folder (``existing``: keys, name) nor was given before. Only
    names that are alike but for such numbers can meet, so folders are parted by what is
    left without them; of these a task holds the names taken. Rows without a name are left out.
    """
    dotted = F.col(name).rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(F.col(name))
    parted = lambda df, at, new: df.select(*keys, stem.alias("_stem"), F.col(name).alias("_name"), at.alias("_at"), F.lit(new).alias("_new")).where("_name is not null")
    kind = names.schema[order].dataType.simpleString()
    rows = parted(names, F.col(order), True)
    if existing is not None:
        rows = rows.unionByName(parted(existing, F.lit(None).cast(kind), False))
    ending = F.expr("substring(_name, length(_stem) + 1)")
    rows = rows.select(*keys, F.regexp_replace("_stem", _NUMBERS, "").alias("_root"), ending.alias("_ending"), "_new", "_at", "_stem", "_name")

    def step(state, row):
        new, at, stem, own = row
        taken, numbers = state
        if not new:
            taken.add(own)
            return state, []
        got = own
        if own in taken:
            n, rest = numbers.get(stem, 2), own[len(stem) :]
            while (got := f"{stem} ({n}){rest}") in taken:
                n += 1
            numbers[stem] = n + 1
        taken.add(got)
        return state, [(at, got)]

    told = w.folded(rows, [*keys, "_root", "_ending"], ["_new", "_at", "_name"], lambda: (set(), {}), step, f"_order {kind}, unique_name string")
    return told.select(*keys, F.col("_order").alias(order), "unique_name")


#: Names ``name (2)`` to ``name (19)`` are looked through for an identical file.
VARIANTS = 19


def imported(incoming: DataFrame, existing: DataFrame, index: DataFrame, folder: str, name: str, key: str, order: str) -> DataFrame:
    """U4: (order, key, path, how) of every incoming file (folder, name, key of its content, order).

    A content that the ``index`` (key, path) has is ``indexed``: the earlier copy is used. Else, if the
    folder has an identical file (``existing``: folder, name, key) under the same name or one numbered up to 19, that is used
    (``identical``), the least number first. Else the file is ``copied`` under a free name. Every later
    file of that content is indexed then. So only the first file of each content is looked for, by equal keys, and only
    copies need their folder's names; frequent contents go back to their files by broadcast.
    """
    work = Kept(incoming.sparkSession, "imported")
    first = incoming.groupBy(key).agg(F.min(F.struct(order, folder, name)).alias("_first"), F.count("*").alias("_n"))
    first = work.keep(first.join(index.groupBy(key).agg(F.min("path").alias("_old")), key, "left").select(key, "_first.*", "_n", "_old"), "first")
    dotted = F.col(name).rlike(r"^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(F.col(name))
    new = first.where("_old is null").withColumn("_stem", stem).withColumn("_ending", F.expr(f"substring(`{name}`, length(_stem) + 1)"))
    alike = new.join(existing.select(folder, key, F.col(name).alias("_there")), [folder, key])
    number = F.when(F.col("_there") == F.col(name), 1).otherwise(F.get(F.filter(F.sequence(F.lit(2), F.lit(VARIANTS)), lambda n: F.col("_there") == F.concat("_stem", F.lit(" ("), n.cast("string"), F.lit(")"), "_ending")), F.lit(0)))
    same = work.keep(alike.withColumn("_number", number).where("_number is not null").groupBy(key).agg(F.min_by("_there", "_number").alias("_same")), "same")
    copies = new.join(same, key, "left_anti")
    names = free_names(copies.select(folder, name, order), [folder], name, order, existing.select(folder, name)).select(folder, order, F.col("unique_name").alias("_made"))
    told = first.join(same, key, "left").join(names, [folder, order], "left")
    how = F.when(F.col("_old").isNotNull(), "indexed").when(F.col("_same").isNotNull(), "identical").otherwise("copied")
    path = F.coalesce("_old", F.concat(F.col(folder).cast("string"), F.lit("/"), F.coalesce("_same", "_made")))
    found = work.keep(told.select(key, F.col(order).alias("_at"), path.alias("path"), how.alias("_how"), "_n"), "found")
    joined = j.join_hot(incoming.select(order, key), found, key, "_n")
    return joined.select(order, key, "path", F.when(F.col(order) == F.col("_at"), F.col("_how")).otherwise("indexed").alias("how"))
