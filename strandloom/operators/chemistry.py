"""Chemistry on columns of SMILES: each distinct text goes through the graph code once and is joined back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import molgraph as g
from ..shared import spread


def per_distinct(df: DataFrame, column: str, schema: str, fn: Callable[[str], tuple]) -> DataFrame:
    """(column, and the fields of ``schema``) for each distinct non-null text."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches):
        import pyarrow as pa

        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
        for b in batches:
            cols = list(zip(*[fn(t) for t in b.column(0).to_pylist()])) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, kinds[x.strip().split()[1]]) for c, x in zip(cols, schema.split(","))]], [column, *names])

    return spread(df.where(F.col(column).isNotNull()).select(column).distinct()).mapInArrow(run, f"`{column}` string, {schema}")


def _mol(text: str):
    try:
        return g.parse(text)
    except (g.NoMolecule, RecursionError):
        return None


def canonical_texts(df: DataFrame, column: str, keep_stereo: bool = True) -> DataFrame:
    """(column, canonical): null where the text can't be read."""
    return per_distinct(df, column, "canonical string", lambda t: (g.canonical_smiles(t, keep_stereo),))


def canonicalised(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.join(canonical_texts(df, column).withColumnRenamed("canonical", out), column, "left")


def structure_features(df: DataFrame, column: str) -> DataFrame:
    """(column, canonical, n_groups, centres, mirrored, methylated, mirrored_methylated): R groups, stereo centres, the mirror
    image, the form with a methyl on the backbone nitrogen, and both at once."""

    def read(t):
        m = _mol(t)
        if m is None:
            return (None,) * 6
        text, groups, centres = g.canonical(m), len(g.group_labels(m)), ";".join(f"{i}{s}" for i, s in g.stereo_centres(m))
        me = g.n_methylated(_mol(t))
        other = g.canonical(g.mirrored(m))
        return text, groups, centres, other, g.canonical(me) if me else None, g.canonical(g.mirrored(me)) if me else None

    return per_distinct(df, column, "canonical string, n_groups int, centres string, mirrored string, methylated string, mirrored_methylated string", read)


NO_SCAFFOLD = "__no_scaffold__"


def scaffolds(df: DataFrame, column: str) -> DataFrame:
    """(column, scaffold): NO_SCAFFOLD without rings or where the text can't be read."""

    def read(t):
        m = _mol(t)
        return ((g.scaffold(m) or NO_SCAFFOLD) if m else NO_SCAFFOLD,)

    return per_distinct(df, column, "scaffold string", read)


def fingerprints(df: DataFrame, column: str, bits: int = 2048, radius: int = 2) -> DataFrame:
    """(column, bits): sorted on-bits, null where the text can't be read."""

    def read(t):
        m = _mol(t)
        return (g.fingerprint(m, radius, bits) if m else None,)

    return per_distinct(df, column, "bits array<int>", read)


def tanimoto(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def neighbours(df: DataFrame, key: str, bits: str = "bits", n_bands: int = 40, rows: int = 2) -> DataFrame:
    """(key, other, similarity): candidate pairs by banded minwise hashes of the on-bits, with exact similarity.

    A pair of similarity s is found with 1 - (1 - s^rows)^n_bands: over 99.9 % at 0.4 and more.
    """
    r = np.random.default_rng(7)
    mult = [int(x) | 1 for x in r.integers(1, 2**31, n_bands * rows)]
    add = [int(x) for x in r.integers(0, 2**31, n_bands * rows)]
    least = lambda i: F.array_min(F.transform(bits, lambda x: F.xxhash64(x * F.lit(mult[i]).cast("long") + F.lit(add[i]).cast("long"))))
    rows_df = df.where(F.size(bits) > 0).select(key, F.explode(F.array(*[F.xxhash64(F.lit(b), *[least(b * rows + k) for k in range(rows)]) for b in range(n_bands)])).alias("bucket"))
    pairs = rows_df.join(rows_df.select(F.col(key).alias("other"), "bucket"), "bucket").where(F.col(key) < F.col("other")).select(key, "other").distinct()
    got = pairs.join(df.select(key, F.col(bits).alias("_a")), key).join(df.select(F.col(key).alias("other"), F.col(bits).alias("_b")), "other")
    return got.select(key, "other", tanimoto(F.col("_a"), F.col("_b")).alias("similarity"))


def nearest_of(df: DataFrame, key: str, asks: Column, holds: Column, bits: str = "bits", width: int = 2048, block: int = 2000) -> DataFrame:
    """(key, nearest array<double>): the largest similarity to any other row, against all of them.

    ``asks`` and ``holds`` are arrays of booleans of one size, a place for each set of rows to compare: nearest[k] is
    that of a row that asks[k] to the others that hold[k], null if there are none. Rows without bits have no result. Each
    pair is looked at once for all places, in blocks of a fixed size that tasks share; the work grows with the square
    of the distinct rows.
    """
    df = df.where(F.col(bits).isNotNull()).select(key, F.col(bits).alias("bits"), asks.alias("asks"), holds.alias("holds"))
    parts = max(1, -(-df.count() // block))
    mine, every = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = df.where(F.exists("asks", lambda x: x)).select(mine.alias("i"), every.alias("j"), F.lit(True).alias("left"), key, "bits", "asks")
    right = df.where(F.exists("holds", lambda x: x)).select(every.alias("i"), mine.alias("j"), F.lit(False).alias("left"), key, "bits", F.col("holds").alias("asks"))

    def dense(t):
        lists = t.column("bits").to_pylist()
        on = np.zeros((len(lists), width), np.float32)
        on[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), [x for y in lists for x in y]] = 1
        return on, np.array(t.column("asks").to_pylist(), bool)

    def compare(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        a, b = table.filter(table.column("left")), table.filter(pc.invert(table.column("left")))
        out = []
        if len(a) and len(b):
            (x, asked), (y, held) = dense(a), dense(b)
            both = (x @ y.T).astype(float)
            alike = both / np.maximum(x.sum(1)[:, None] + y.sum(1)[None, :] - both, 1)
            at = {k: j for j, k in enumerate(b.column(key).to_pylist())}
            for i, k in enumerate(a.column(key).to_pylist()):
                if k in at:
                    alike[i, at[k]] = -1
            best = np.stack([np.where(h[None, :], alike, -1).max(1) for h in held.T], 1)
            out = [[v if q and v >= 0 else None for v, q in zip(r, o)] for r, o in zip(best.tolist(), asked.tolist())]
        return pa.table({key: a.column(key) if out else a.column(key).slice(0, 0), "found": pa.array(out, pa.list_(pa.float64()))})

    found = left.unionByName(right).groupBy("i", "j").applyInArrow(compare, f"`{key}` {df.schema[key].dataType.simpleString()}, found array<double>")
    best = found.select(key, F.posexplode("found").alias("_k", "_s")).groupBy(key, "_k").agg(F.max("_s").alias("_s"))
    return best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda x: x["_s"]).alias("nearest"))


def padded_vector(v: Column, size: int) -> Column:
    """Cut, or filled with zeros, to a size; null stays null."""
    return F.when(v.isNotNull(), F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size))


def medians_by_structure(df: DataFrame, smiles: str, values: list[str], order: str) -> DataFrame:
    """A5: one row per molecule: the first row (by ``order``) of those with one canonical structure gives all other columns,
    each value column its median (text that is no number counts as missing), ``smiles`` the canonical text. A text
    that can't be read is its own key, and so is null; ``n_rows`` counts the rows. A table without repeated molecules comes
    out with canonical texts and nothing else changed."""
    texts = canonical_texts(df, smiles).select(smiles, F.coalesce("canonical", smiles).alias("_key"))
    keyed = df.where(F.col(smiles).isNotNull()).join(texts, smiles).unionByName(df.where(F.col(smiles).isNull()).withColumn("_key", F.lit(None).cast("string")))
    rest = [c for c in df.columns if c != smiles and c not in values]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(F.col(order).isNull(), F.col(order))).alias("_r")
    got = keyed.groupBy("_key").agg(first, *[F.median(F.col(c).try_cast("double")).alias(c) for c in values], F.count("*").alias("n_rows"))
    return got.select(F.col("_key").alias(smiles), "_r.*", *values, "n_rows")


def merged_library(entries: DataFrame) -> DataFrame:
    """(core, n_rgroups, monomer_type, symbol, alt_symbols, source) from (symbol, core, n_rgroups, monomer_type, source,
    priority, entry_id).

    A symbol is its first entry's, by priority and entry_id: later entries with it are left out. Entries of one structure become
    one in the order of priority, generic names last, symbol: the first symbol leads, the others follow it, and a source is
    added with ``+`` unless the text so far holds it. Entries without a structure are left out.
    """
    from .curate import first_by_key

    one = first_by_key(entries.where(F.col("symbol").isNotNull() & F.col("core").isNotNull()), ["symbol"], ["priority", "entry_id"])
    at = F.struct("priority", F.col("symbol").rlike("(?i)^(Mono|X)[0-9]+$").alias("generic"), "symbol", F.coalesce("source", F.lit("")).alias("source"))
    got = one.groupBy("core", "n_rgroups", "monomer_type").agg(F.sort_array(F.collect_list(at)).alias("e"))  # the entries of one structure
    joined = F.aggregate("e", F.lit(""), lambda acc, x: F.when(acc == "", x["source"]).when(F.contains(acc, x["source"]), acc).otherwise(F.concat(acc, F.lit("+"), x["source"])))
    return got.select("core", "n_rgroups", "monomer_type", F.col("e")[0]["symbol"].alias("symbol"), F.array_join(F.transform(F.slice("e", 2, F.size("e")), lambda x: x["symbol"]), ";").alias("alt_symbols"), joined.alias("source"))


def generated_structures(wanted: DataFrame, sources: list[tuple[str, DataFrame]], parents: DataFrame) -> DataFrame:
    """V6: (symbol, smiles, origin) of each distinct symbol of ``wanted``: from the first of the named ``sources`` (symbol,
    smiles) that has it, else made from its parent's structure (``parents``: symbol, smiles): turned round for ``d``,
    methylated for ``me``, both for ``Me_d``, as it is for the parent's own name; origin ``none`` if there is no parent."""
    got = wanted.where("symbol IS NOT NULL").select("symbol").distinct()
    for k, (_, table) in enumerate(sources):
        got = got.join(table.where("smiles IS NOT NULL AND symbol IS NOT NULL").groupBy("symbol").agg(F.min("smiles").alias(f"_s{k}")), "symbol", "left")
    got = got.withColumn("parent", F.regexp_replace("symbol", "^(Me_d|me|d)(?=[A-Z])", ""))
    one = parents.groupBy(F.col("symbol").alias("parent")).agg(F.min("smiles").alias("_p"))
    forms = structure_features(one.withColumnRenamed("_p", "smiles"), "smiles")
    made = one.join(forms.withColumnRenamed("smiles", "_p"), "_p").select("parent", "canonical", "mirrored", "methylated", "mirrored_methylated")
    s = F.col("symbol")
    form = F.when(s == F.col("parent"), F.col("canonical")).when(s.startswith("Me_d"), F.col("mirrored_methylated")).when(s.startswith("me"), F.col("methylated")).otherwise(F.col("mirrored"))
    got = got.join(made, "parent", "left").withColumn("_made", form)
    origin = F.when(F.col("_made").isNotNull(), "generated").otherwise("none")
    for k in reversed(range(len(sources))):
        origin = F.when(F.col(f"_s{k}").isNotNull(), sources[k][0]).otherwise(origin)
    return got.select("symbol", F.coalesce(*[F.col(f"_s{k}") for k in range(len(sources))], "_made").alias("smiles"), origin.alias("origin"))


def pair_features(df: DataFrame, smiles: str, sequence: str, bits: int = 2048) -> DataFrame:
    """(smiles, sequence, features) of the distinct pairs: the structure's fingerprint as 0 and 1, then the sequence's
    residue shares and length share. Pairs whose structure can't be read, or with an empty sequence, are left out."""
    from ..functions.helm import composition

    pairs = df.where((F.length(sequence) > 0) & F.col(smiles).isNotNull()).select(smiles, sequence).distinct()
    on = fingerprints(pairs, smiles, bits).where("bits IS NOT NULL")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    gaps = F.transform(F.sequence(F.lit(0), F.size("bits") - 1), lambda i: F.concat(zeros(F.get("bits", i) - F.coalesce(F.when(i > 0, F.get("bits", i - 1)), F.lit(-1)) - 1), F.array(F.lit(1.0))))
    dense = F.when(F.size("bits") > 0, F.concat(F.flatten(gaps), zeros(F.lit(bits) - 1 - F.element_at("bits", -1)))).otherwise(zeros(F.lit(bits)))
    return pairs.join(on.select(smiles, dense.alias("_f")), smiles).select(smiles, sequence, F.concat("_f", F.array(*composition(sequence))).alias("features"))
