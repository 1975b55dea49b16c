"""Problem 2: matching entities across sources without keys.

Loopy belief propagation over candidate pairs with one-to-one factors: every pair gets log-odds from its partial, noisy
attributes; the factor of each entity lets at most one of its pairs be true; messages are exchanged through joins until
they stand still, and each pair's marginal probability is its confidence.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.molgraph import NoMolecule, canonical, group_labels, parse
from ..functions.smiles import core
from ..operators.chemistry import per_distinct
from ..operators.joins import fits
from ..shared import keep, written

#: A word is rightly spelt if so many records have it and no word within two edits is so many times as frequent (in
#: words of one or two letters, which are all alike, the second figure).
WORD_ROWS, WORD_RATIO, SHORT_RATIO = 3, 10, 100
#: Log-odds of the evidence (equal, unequal), and of a pair before any.
STRUCTURE, NAME, NEAR_NAME, SYMBOL, GROUPS, KIND, PRIOR = 26.0, (10.0, -12.0), (7.0, -8.0), (3.0, -3.0), (0.5, -2.0), (0.5, -1.0), -6.0
#: Of a cut structure's 5-character shingles, the share found in the other's text, and its log-odds.
CONTAINED = ((0.85, 4.0), (0.6, 1.0), (-1.0, -5.0))
LIMIT, TOLERANCE, CONFIDENT = 20.0, 1e-3, 0.5
#: Rounds in which messages are replaced whole; later ones move by a share that shrinks, so that none swing for ever.
FULL_ROUNDS = 10
GENERIC = re.compile(r"(?i)^(mono|x)\d+$")


def _near_keys(word: Column, own: bool) -> Column:
    """Keys by which words within two edits meet: two edits leave one of a word's three parts whole, at most two places
    off. ``own``: the parts themselves; else what another word holds there, for each length within two."""
    n = F.length(word)
    cut = lambda size, i: F.floor(size * i / 3).cast("int")
    key = lambda size, i, shift: F.concat_ws(":", size.cast("string"), i.cast("string"), F.substring(word, cut(size, i) + shift + 1, cut(size, i + 1) - cut(size, i)))
    parts = F.array(*[F.lit(i) for i in range(3)])
    if own:
        return F.transform(parts, lambda i: key(n, i, F.lit(0)))
    every = lambda low, high, fn: F.flatten(F.transform(F.sequence(F.lit(low), F.lit(high)), fn))
    at = lambda size, i: F.transform(F.filter(F.sequence(F.lit(-2), F.lit(2)), lambda d: cut(size, i) + d >= 0), lambda d: key(size, i, d))
    return F.array_distinct(every(-2, 2, lambda d: F.flatten(F.transform(parts, lambda i: at(n + d, i)))))


def spelling(words: DataFrame) -> DataFrame:
    """(w, right array<string>) of the words of (w, n) that can be read: rightly spelt ones, misspelt ones with the one
    nearest frequent word, and two rightly spelt ones run together.

    A word has a rival if another one within two edits (one in words of up to four letters, where a swap of neighbours
    counts as one) is WORD_RATIO times as frequent. A word with rivals is misspelt: it stands for the nearest, or for
    nothing if two are as near. All is joins over the distinct words.
    """
    frequent = words.where(F.col("n") >= WORD_RATIO).select(F.col("w").alias("x"), F.col("n").alias("n_x"), F.explode(_near_keys(F.col("w"), True)).alias("key"))
    probes = words.select("w", "n", F.explode(_near_keys(F.col("w"), False)).alias("key"))
    pairs = probes.join(frequent, "key").where("w <> x").where(F.col("n_x") >= F.col("n") * F.when(F.length("w") > 2, WORD_RATIO).otherwise(SHORT_RATIO)).select("w", "x").distinct()
    letters = lambda c: F.array_sort(F.split(c, ""))
    d = F.levenshtein("w", "x")
    d = F.when((d == 2) & (F.length("w") == F.length("x")) & (letters("w") == letters("x")), 1).otherwise(d)
    near = pairs.withColumn("d", d).where(F.col("d") <= F.when(F.length("w") > 4, 2).otherwise(1))
    best = near.groupBy("w").agg(F.min(F.struct("d", "x")).alias("best"), F.min("d").alias("d0"), F.collect_set(F.struct("d", "x")).alias("all"))  # frequent words within two edits
    one = F.size(F.filter("all", lambda r: r["d"] == F.col("d0"))) == 1
    judged = words.join(best, "w", "left")
    known = judged.where(F.col("best").isNull() & (F.col("n") >= WORD_ROWS)).select("w", F.array("w").alias("right"))
    fixed = judged.where(one & (F.length("best.x") > 2) & (F.length("w") > 1)).select("w", F.array("best.x").alias("right"))
    done = written(known.unionByName(fixed), "words")
    sound = done.where("right[0] = w").select("w")
    rest = words.join(done, "w", "left_anti").where("length(w) > 3").select("w", F.explode(F.sequence(F.lit(1), F.length("w") - 1)).alias("i"))
    halves = rest.select("w", "i", F.expr("left(w, i)").alias("l"), F.expr("substring(w, i + 1)").alias("r"))
    joined = halves.join(sound.withColumnRenamed("w", "l"), "l", "left_semi").join(sound.withColumnRenamed("w", "r"), "r", "left_semi")
    return done.unionByName(joined.groupBy("w").agg(F.min_by(F.array("l", "r"), "i").alias("right")))


def read_names(names: DataFrame) -> DataFrame:
    """(name, words, sure) of distinct (name, n): its words as they are rightly spelt, and whether all could be read.
    Names of fewer than three words name nothing and have no row."""
    tokens = F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))
    words = names.select("n", F.explode(F.array_distinct(tokens)).alias("w")).groupBy("w").agg(F.sum("n").alias("n"))
    right = spelling(written(words, "counts"))
    each = names.select("name", F.posexplode(tokens).alias("i", "w"))
    read = each.join(F.broadcast(right) if fits(right, 300) else right, "w", "left").withColumn("sure", F.col("right").isNotNull())
    read = read.withColumn("right", F.coalesce("right", F.array("w")))
    got = read.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("i", "right"))).alias("all"), F.min("sure").alias("sure"))  # the words of one name
    return got.select("name", F.flatten(F.transform("all", lambda x: x["right"])).alias("words"), "sure").where("size(words) > 2")


def read_structure(text: str | None) -> tuple[str | None, int | None, str | None]:
    """(canonical text with R groups and stereo, number of R groups, None), or (None, None, what is there of a cut one)."""
    try:
        m = parse(text)
        groups = group_labels(m)
        if 0 in groups and any(groups):  # names of some R groups are cut off
            return None, None, core(text)
        return canonical(m), len(groups), None
    except (NoMolecule, RecursionError):
        return None, None, core(text) or None


def _flat(smiles: str) -> str:
    """Letters, digits and bonds that do not hang on how rings are written."""
    return re.sub(r"C1=CC=C\(C=C1\)", "c1ccc(cc1)", smiles)


def contained(cut: str | None, whole: str | None, k: int = 5) -> float | None:
    """Share of a cut structure's shingles that stand in a whole text; None if there are fewer than four."""
    if not cut or not whole:
        return None
    a, b = _flat(cut), _flat(whole)
    mine = {a[i : i + k] for i in range(len(a) - k + 1)}
    return sum(x in b for x in mine) / len(mine) if len(mine) > 3 else None


def features(sides: list[tuple[str, DataFrame, dict[str, str]]]) -> DataFrame:
    """One row per record with what its attributes say: side, id, key (canonical structure), n_groups, cut (what is there
    of a cut structure), written, words, name (null unless every word could be read), symbol, kind. ``sides`` maps id, smiles,
    name, symbol, kind, groups to columns. Structures and names are read once for each distinct text."""
    rows = None
    for side, df, c in sides:
        part = df.select(F.lit(side).alias("side"), F.col(c["id"]).cast("long").alias("id"), *[F.col(c[x]).cast("string").alias(x) for x in ("smiles", "name", "symbol", "kind")], F.col(c["groups"]).cast("int").alias("groups"))
        rows = part if rows is None else rows.unionByName(part)
    structures = per_distinct(rows, "smiles", "key string, n int, cut string", read_structure)
    names = read_names(rows.where("name IS NOT NULL").groupBy("name").agg(F.count("*").alias("n")))
    symbols = F.regexp_replace(F.trim("symbol"), r"(_\d+|-\d+|\(\d+\))$", "")
    symbol = F.when(~F.trim("symbol").rlike(GENERIC.pattern), F.nullif(F.regexp_replace(F.lower(symbols), "^nme-?", "me"), F.lit("")))
    kind = F.lower(F.trim("kind"))
    for column, table in (("smiles", structures), ("name", names)):  # a null text meets nothing, and not in one task
        lone = F.concat(F.lit("\0"), F.col("side"), F.col("id").cast("string"))
        rows = rows.withColumn("at", F.coalesce(column, lone)).join(table.withColumnRenamed(column, "at"), "at", "left").drop("at")
    return rows.select(
        "side", "id", "key", F.coalesce("n", "groups").alias("n_groups"), "cut", F.when(F.col("key").isNotNull(), F.col("smiles")).alias("written"),
        "words", F.when(F.col("sure"), F.array_join("words", " ")).alias("name"), symbol.alias("symbol"), F.when(~kind.isin("", "undefined"), kind).alias("kind"),
    )


def entities(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, entities): records of one table that are the same by structure or by full name are one entity of that
    table, so that repeated records do not compete for one partner.

    A rightly spelt name stands for the one structure that rows with this name have, in either table. Records that say
    neither are one entity if they say the same in all else. An entity of one table is never one of the other: whether
    two are the same is left to the messages.
    """
    rows = written(rows, "records")
    spelt = rows.where("key IS NOT NULL AND name IS NOT NULL").groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a = b").select(F.col("name").alias("at"), F.col("a").alias("named"))
    rows = rows.withColumn("at", F.coalesce("name", F.concat(F.lit("\0"), "side", F.col("id").cast("string")))).join(spelt, "at", "left").drop("at")
    other = F.to_json(F.struct("cut", "words", "symbol", "kind", "n_groups"))
    says = F.coalesce("cut", F.array_join("words", " "), "symbol").isNotNull()
    ident = F.coalesce(F.concat(F.lit("S"), F.coalesce("key", "named")), F.concat(F.lit("N"), "name"), F.when(says, F.concat(F.lit("O"), other)), F.concat(F.lit("R"), F.col("id").cast("string")))
    rows = written(rows.withColumn("entity", F.md5(F.concat("side", ident))), "members")
    first = lambda c: F.min(c).alias(c)
    found = rows.groupBy("side", "entity").agg(*[first(c) for c in ("key", "n_groups", "cut", "written", "words", "symbol", "kind")], F.max("name").isNotNull().alias("named"))
    return rows, written(found, "entities")


def _near_blocks(words: Column, symbol: Column) -> Column:
    """Hashes under which names of one length meet if one word at most differs: it stands in one quarter of the name, so all
    words without that quarter are equal. Of names of up to five words too little is left, so there the symbol must be equal
    too, or all words. A clash of hashes costs a look at a pair, no more."""
    n = F.size(words)
    at = lambda i: F.floor(n * i / 4).cast("int")
    rest = [F.concat(F.slice(words, F.lit(1), at(i)), F.slice(words, at(i + 1) + 1, n)) for i in range(4)]
    long = F.array(*[F.xxhash64(n, F.lit(i), r) for i, r in enumerate(rest)])
    short = F.array(F.xxhash64(n, words), *[F.when(symbol.isNotNull(), F.xxhash64(n, F.lit(i), r, symbol)) for i, r in enumerate(rest)])
    return F.array_distinct(F.array_compact(F.when(n > 5, long).otherwise(short)))


ATTRIBUTES = ("key", "n_groups", "cut", "written", "named", "words", "symbol", "kind")


def _side(rows: DataFrame, side: str) -> DataFrame:
    """The rows of one side, their entity as column ``side``, their attributes with its name behind."""
    return rows.where(F.col("side") == side).withColumnsRenamed({"entity": side} | {c: f"{c}_{side}" for c in rows.columns if c in (*ATTRIBUTES, "poor", "mute")}).drop("side")


def candidates(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, theta): pairs of entities with one structure; where one of them lacks a structure, also those that share a
    full name, a name but for one word, or a symbol, if their attributes say more for them than against them.

    Pairs under a symbol are judged where they meet, and two other names are not looked at there: they outweigh a symbol and
    all that may go with it, and equal or near names meet by themselves. So what is kept of a table does not grow with the
    square of the rows that share a symbol or the first words of a name, but only of those that say nothing else.
    """
    bare = found.select("side", "entity", *ATTRIBUTES, F.col("key").isNull().alias("poor"), F.col("words").isNull().alias("mute"))
    own = lambda c: members.where(c + " IS NOT NULL").select("side", "entity", "name", "words", "symbol").join(bare.select("side", "entity", "poor"), ["side", "entity"])

    def meet(keys: DataFrame) -> DataFrame:  # only pairs with a poor side are looked for
        a, b = (_side(keys.distinct(), s) for s in "ab")
        return a.where("poor_a").join(b, "block").unionByName(a.where("NOT poor_a").join(b.where("poor_b"), "block")).select("a", "b")

    named = meet(own("name").select("side", "entity", "poor", F.col("name").alias("block"))).withColumn("one_name", F.lit(True))
    near = meet(own("words").select("side", "entity", "poor", F.explode(_near_blocks(F.col("words"), F.col("symbol"))).alias("block"))).distinct().withColumn("one_name", F.lit(False))
    pairs = named.unionByName(near)
    for s in "ab":
        pairs = pairs.join(_side(bare, s), s)
    # Each row of a meets the classes of b with which it is a pair that has a poor and a mute side.
    poor, mute = F.col("poor"), F.col("mute")
    by = members.where("symbol IS NOT NULL").select("side", "entity", F.col("symbol").alias("block")).distinct().join(bare.drop("words").withColumn("words", F.lit(None).cast("array<string>")), ["side", "entity"])
    kinds = F.array(*[F.when((poor | F.lit(bool(p))) & (mute | F.lit(bool(m))), F.lit(2 * p + m)) for p in (0, 1) for m in (0, 1)])
    a = _side(by.withColumn("class", F.explode(F.array_compact(kinds))), "a")
    b = _side(by.withColumn("class", 2 * poor.cast("int") + mute.cast("int")), "b")
    symbols = a.join(b, ["block", "class"]).withColumn("one_name", F.lit(False))
    loose = judged(pairs).unionByName(judged(symbols)).groupBy("a", "b").agg(F.max("theta").alias("theta"))  # one name says more than none
    of = lambda s: found.where((F.col("side") == s) & F.col("key").isNotNull()).select("key", F.col("entity").alias(s))
    return loose.unionByName(of("a").join(of("b"), "key").select("a", "b", F.lit(min(LIMIT, PRIOR + STRUCTURE)).alias("theta")))


def judged(pairs: DataFrame) -> DataFrame:
    """(a, b, theta): what the attributes say of pairs that are not both whole structures, as log-odds; only of pairs for which
    they say more than against them."""
    share = F.udf(lambda ca, wa, cb, wb: contained(ca, wb) if ca else contained(cb, wa), "double", useArrow=True)
    both = lambda c: F.col(f"{c}_a").isNotNull() & F.col(f"{c}_b").isNotNull()
    same = lambda c, w: F.when(both(c), F.when(F.col(f"{c}_a") == F.col(f"{c}_b"), w[0]).otherwise(w[1])).otherwise(0.0)
    aligned = F.size(F.filter(F.zip_with("words_a", "words_b", lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    near = F.when(both("words") & (F.size("words_a") == F.size("words_b")) & (aligned <= 1), NEAR_NAME[0]).when(both("words"), NEAR_NAME[1]).otherwise(0.0)
    name = F.when(F.col("one_name"), NAME[0]).when(F.col("named_a") & F.col("named_b"), NAME[1]).otherwise(near)
    inside = F.when(F.col("c") >= CONTAINED[0][0], CONTAINED[0][1]).when(F.col("c") >= CONTAINED[1][0], CONTAINED[1][1]).when(F.col("c").isNotNull(), CONTAINED[2][1]).otherwise(0.0)
    inside = F.when(F.col("one_name"), F.greatest(inside, F.lit(0.0))).otherwise(inside)  # a full name outweighs another way to write a cut text
    rest = name + same("symbol", SYMBOL) + same("n_groups", GROUPS) + same("kind", KIND)
    got = pairs.select("a", "b", "one_name", "cut_a", "written_a", "cut_b", "written_b", rest.alias("rest")).where(F.col("rest") + CONTAINED[0][1] > 0)
    got = got.withColumn("c", share("cut_a", "written_a", "cut_b", "written_b")).select("a", "b", (F.lit(PRIOR) + F.col("rest") + inside).alias("theta"))
    return got.where(F.col("theta") > PRIOR).withColumn("theta", F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.col("theta"))))


def marginals(pairs: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b, confidence) from (a, b, theta).

    The factor of an entity sends to each of its pairs -log(1 + sum over its other pairs of exp(theta + the message from
    the other end)). Sums are made per entity by aggregation, so an entity with very many pairs is no single task's
    burden, and joined back to its pairs. A pair both of whose ends have no other has nothing to be told, so its messages
    are 0 from the start; all others go round until no message moves by more than ``tolerance``, however many rounds that
    takes: after FULL_ROUNDS messages move only part of the way, less with each round.
    """
    count = lambda s: pairs.groupBy(s).agg(F.count("*").alias(f"n_{s}"))
    named = written(pairs.join(count("a"), "a").join(count("b"), "b").select("a", "b", "theta", (F.greatest("n_a", "n_b") == 1).alias("alone")), "pairs")
    state = keep(named.where("NOT alone").select("a", "b", "theta", F.lit(0.0).alias("from_a"), F.lit(0.0).alias("from_b")), "messages")
    round_no = 0
    while True:
        round_no += 1
        step, now = F.lit(min(1.0, FULL_ROUNDS / round_no)), state.df
        for s, out, got in (("a", "from_a", "from_b"), ("b", "from_b", "from_a")):
            now = now.withColumn("x", F.exp(F.least(F.lit(LIMIT), F.col("theta") + F.col(got))))
            total = now.groupBy(s).agg(F.sum("x").alias("total"))
            rest = F.greatest(F.col("total") - F.col("x"), F.lit(0.0))
            now = now.join(total, s).withColumn(f"new_{s}", F.col(out) + step * (-F.log1p(rest) - F.col(out)))
            now = now.withColumn(f"moved_{s}", F.abs(F.col(f"new_{s}") - F.col(out))).withColumn(out, F.col(f"new_{s}")).drop("x", "total", f"new_{s}")
        after = keep(now.select("a", "b", "theta", "from_a", "from_b", F.greatest("moved_a", "moved_b").alias("moved")), "messages")
        moved = after.df.agg(F.max("moved")).first()[0] or 0.0
        state.drop()
        state = after
        if moved <= tolerance:
            break
    told = state.df.select("a", "b", (F.col("theta") + F.col("from_a") + F.col("from_b")).alias("belief"))
    return told.unionByName(named.where("alone").select("a", "b", F.col("theta").alias("belief"))).select("a", "b", (1 / (1 + F.exp(-F.col("belief")))).alias("confidence"))


def match(a: DataFrame, a_columns: dict[str, str], b: DataFrame, b_columns: dict[str, str]) -> DataFrame:
    """(id_a, id_b, confidence) of all pairs of records that may be the same thing.

    Null, empty and broken attributes count as missing, never as unequal. Records that are repeated in a table match
    alike. Empty tables give no pairs.
    """
    members, found = entities(features([("a", a, a_columns), ("b", b, b_columns)]))
    scored = marginals(written(candidates(members, found), "candidates"))
    side = lambda s: members.where(F.col("side") == s).select(F.col("entity").alias(s), F.col("id").alias(f"id_{s}"))
    return scored.join(side("a"), "a").join(side("b"), "b").select("id_a", "id_b", "confidence")


CYCPEPT = {"id": "cycpept_id", "smiles": "cxsmiles", "name": "compound_name", "symbol": "symbol", "kind": "monomer_type", "groups": "n_rgroups"}
CHEMBL = {"id": "chembl_id", "smiles": "monomer_smiles", "name": "monomer_name", "symbol": "monomer_id", "kind": "monomer_type", "groups": "n_rgroups"}


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with their confidence."""
    got = match(spark.read.parquet(f"{sf_dir}/cycpept_monomers.parquet"), CYCPEPT, spark.read.parquet(f"{sf_dir}/chembl_monomers.parquet"), CHEMBL)
    return got.where(F.col("confidence") > CONFIDENT).select(F.col("id_a").alias("cycpept_id"), F.col("id_b").alias("chembl_id"), F.round("confidence", 6).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("cycpept_id", "chembl_id")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches}
SQL: dict[str, str] = {}
