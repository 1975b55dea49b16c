"""Problem 3: rows that fail to parse.

Minimum-cost error parse of delimited lines. A dynamic program reads the line as quoted and plain fields and may insert
or delete quotes and delimiters; a value that is not valid in its column costs something too. A quote edit costs more
than any number of delimiter edits, and these more than any number of bad values. Lines read at no cost load as typed
rows; of all others, the dearest part of the cheapest path is the reason, and its edits say what would mend them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.smiles import fault
from ..shared import spread

#: Cost of a quote edit, of a delimiter edit and of a value that its column does not take.
QUOTE_COST, DELIMITER_COST, VALUE_COST = 1 << 80, 1 << 40, 1
#: Where the parse stands: at a field's start, in an unquoted field, inside quotes, after a quote inside quotes.
START, PLAIN, QUOTED, AFTER = range(4)
_TOKENS = re.compile(r'[",]|[^",]+')


@dataclass(frozen=True)
class Feed:
    """Columns of a feed, checks of trimmed values (True: valid) and Spark types of the loaded columns."""

    columns: tuple[str, ...]
    checks: dict[str, Callable[[str], bool]] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


MONOMER_TYPES = ("Backbone", "Terminal", "Branch", "Undefined")
_given: Callable[[str], bool] = bool
_smiles = lambda v: fault(v) is None
FEEDS = {
    "monomer_library": Feed(
        ("symbol", "name", "natural_analog", "smiles", "monomer_type", "n_rgroups", "source", "alt_symbols"),
        {"symbol": _given, "monomer_type": lambda v: v in MONOMER_TYPES, "n_rgroups": lambda v: v.isascii() and v.isdigit(), "smiles": _smiles},
        {"n_rgroups": "decimal(38,0)"},
    ),
    "compound_final": Feed(
        ("compound_chembl_id", "helm_notation", "canonical_smiles", "normalized_smiles", "source_ids", "helm_smiles_consistent"),
        {"compound_chembl_id": _given, "helm_notation": _given, "helm_smiles_consistent": lambda v: v.lower() in ("true", "false"), "normalized_smiles": _smiles},
        {"helm_smiles_consistent": "boolean"},
    ),
}


@dataclass
class Reading:
    """The cheapest way to read a line: its fields, the places of the delimiters between them, the quote edits."""

    quotes: int
    edits: list[tuple[int, str]]
    fields: list[str]
    places: list[int]


def _free_path(line: str) -> tuple[list[str], list[int]] | None:
    """Fields and places of the delimiters along the program's path without a quote edit, None if it breaks off."""
    fields, places, mode, held, at = [], [], START, [], 0
    for token in _TOKENS.findall(line):
        if mode == QUOTED:
            if token == '"':
                mode = AFTER
            else:
                held.append(token)
        elif token == ",":
            fields.append("".join(held))
            places.append(at)
            mode, held = START, []
        elif token == '"':
            if mode == PLAIN:
                return None
            if mode == AFTER:
                held.append('"')
            mode = QUOTED
        elif mode == AFTER:
            return None
        else:
            mode = PLAIN
            held.append(token)
        at += len(token)
    return None if mode == QUOTED else ([*fields, "".join(held)], places)


def read_line(line: str, width: int) -> Reading:
    """The way to read ``line`` with the fewest quote edits and, among those, the number of fields nearest to ``width``.

    States are the mode and the field number (surplus fields count as the last). Quotes may be inserted anywhere and
    deleted. A delimiter outside quotes ends its field whether it stays or not, so no edit of delimiters mends a quote.
    The path without a quote edit has one state for each token, so it is followed first; all states are looked at where
    it breaks off. Time and space are linear in the tokens of the line.
    """
    free = _free_path(line)
    if free is not None:
        return Reading(0, [], *free)
    never = 1 << 120
    states = 4 * width
    cost, back = [never] * states, []
    cost[START] = 0

    def insert_quotes(steps):
        for _ in range(2):
            for s in range(states):
                mode = s % 4
                if mode != PLAIN and cost[s] < never:
                    to = s - mode + (QUOTED if mode in (START, AFTER) else AFTER)
                    if cost[s] + QUOTE_COST < cost[to]:
                        cost[to] = cost[s] + QUOTE_COST
                        steps[to] = s

    tokens, places, at = _TOKENS.findall(line), [], 0
    for token in tokens:
        before: dict = {}
        insert_quotes(before)
        new, step = [never] * states, {}

        def go(s, to, extra, deleted=False):
            if cost[s] + extra < new[to]:
                new[to] = cost[s] + extra
                step[to] = (s, deleted)

        for s in range(states):
            if cost[s] == never:
                continue
            mode, base = s % 4, s - s % 4
            if token == '"':
                go(s, s, QUOTE_COST, True)
                if mode in (START, AFTER):
                    go(s, base + QUOTED, 0)
                elif mode == QUOTED:
                    go(s, base + AFTER, 0)
            elif mode == QUOTED:
                go(s, s, 0)
            elif token == ",":
                if base + 4 < states:
                    go(s, base + 4 + START, 0)
                else:
                    go(s, base + START, DELIMITER_COST)
            elif mode != AFTER:
                go(s, base + PLAIN, 0)
        back.append((before, step))
        places.append(at)
        cost = new
        at += len(token)
    last: dict = {}
    insert_quotes(last)
    total = {s: cost[s] + (width - 1 - s // 4) * DELIMITER_COST for s in range(states) if s % 4 != QUOTED and cost[s] < never}
    s = min(total, key=lambda x: (total[x], x))
    quotes, edits, fields, between, held = total[s] // QUOTE_COST, [], [], [], []

    def undo_inserts(steps, place):
        nonlocal s
        for _ in range(2):
            if s in steps:
                edits.append((place, "insert quote"))
                if s % 4 == QUOTED and steps[s] % 4 == AFTER:  # the second of a doubled quote
                    held.append('"')
                s = steps[s]

    undo_inserts(last, at)
    for (before, step), place, token in zip(reversed(back), reversed(places), reversed(tokens)):
        after, (s, deleted) = s, step[s]
        if deleted:
            edits.append((place, "delete quote"))
        elif token == ",":
            if s % 4 == QUOTED:
                held.append(token)
            else:
                fields.append("".join(reversed(held)))
                between.append(place)
                held.clear()
        elif token != '"' or s % 4 == AFTER and after % 4 == QUOTED:
            held.append(token)
        undo_inserts(before, place)
    fields.append("".join(reversed(held)))
    return Reading(quotes, edits[::-1], fields[::-1], between[::-1])


def fit_columns(fields: list[str], places: list[int], feed: Feed, end: int) -> tuple[list[tuple[int, str]], list[str], list[str]]:
    """(delimiter edits, columns with bad values, trimmed values) of the cheapest way to lay fields on the columns.

    Surplus delimiters are deleted within one column, missing ones inserted at one place: where the fewest values are
    bad, then furthest right. Each choice keeps the fields before it in their columns and those after it aligned with
    the end, so sums from both ends judge them all; time is linear in the fields.
    """
    names, n, m = feed.columns, len(feed.columns), len(fields)
    fields = [v.strip() for v in fields]
    bad = lambda c, v: names[c] in feed.checks and not feed.checks[names[c]](v)
    few = min(m, n)
    front = [0] * (few + 1)
    for i in range(few):
        front[i + 1] = front[i] + bad(i, fields[i])
    if m == n:
        return [], [names[c] for c in range(n) if front[c + 1] > front[c]], fields
    tail = [0] * (few + 1)  # the last i fields in the last i columns
    for i in range(few):
        tail[i + 1] = tail[i] + bad(n - 1 - i, fields[m - 1 - i])
    if m > n:
        whole = lambda c: "".join(fields[c : m - n + c + 1])
        c = min(range(n), key=lambda c: (front[c] + bad(c, whole(c)) + tail[n - 1 - c], -c))
        laid, edits = [*fields[:c], whole(c), *fields[m - n + c + 1 :]], [(p, "delete delimiter") for p in places[c : m - n + c]]
    else:
        empty = [0] * (n + 1)
        for i in range(n):
            empty[i + 1] = empty[i] + bad(i, "")
        c = min(range(m + 1), key=lambda c: (front[c] + empty[c + n - m] - empty[c] + tail[m - c], -c))
        laid, edits = [*fields[:c], *[""] * (n - m), *fields[c:]], [(0 if not c else places[c - 1] if c <= len(places) else end, "insert delimiter")] * (n - m)
    return edits, [names[i] for i in range(n) if bad(i, laid[i])], laid


def judge(line: str | None, feed: Feed | None) -> tuple[str | None, str | None, list[str] | None]:
    """(reason, detail, fields): reason is None for a line that is read at no cost, else comment, or what the dearest part
    of its cost is: quoting, columns or value.

    A null line counts as an empty one. A feed that is not known has no columns, so its lines fail by ``columns``
    unless their quotes are broken.
    """
    line = re.sub(r"[\r\n]+$", "", line or "")
    if line.lstrip()[:1] == "#":
        return "comment", None, None
    got = read_line(line, len(feed.columns) if feed else 1)
    if feed is None:
        return ("quoting" if got.quotes else "columns"), "unknown feed", None
    moved, bad, fields = fit_columns(got.fields, got.places, feed, len(line))
    cost = got.quotes * QUOTE_COST + len(moved) * DELIMITER_COST + len(bad) * VALUE_COST
    if not cost:
        return None, None, fields
    edits = [f"{what} at {place}" for place, what in sorted([*got.edits, *moved], key=lambda x: x[0])]
    reason = "quoting" if cost >= QUOTE_COST else "columns" if cost >= DELIMITER_COST else "value"
    return reason, "; ".join([*edits, *[f"value of {c}" for c in bad]]), None


def parse_lines(lines: DataFrame, feeds: dict[str, Feed] | None = None) -> DataFrame:
    """(line_id, feed, reason, detail, fields) of every line; comments have the reason ``comment``.

    ``detail`` lists the edits of the cheapest repair and the columns whose values are still bad. ``lines`` needs line_id, feed
    and raw_line; other columns are ignored. Lines are judged one by one, without a shuffle.
    """
    feeds = feeds or FEEDS

    def run(batches: Iterator):
        import pyarrow as pa

        for b in batches:
            got = [judge(line, feeds.get(f)) for line, f in zip(b.column("raw_line").to_pylist(), b.column("feed").to_pylist())]
            reason, detail, fields = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("line_id"), b.column("feed"), pa.array(reason, pa.string()), pa.array(detail, pa.string()), pa.array(fields, pa.list_(pa.string()))], ["line_id", "feed", "reason", "detail", "fields"])

    return spread(lines.select("line_id", "feed", "raw_line")).mapInArrow(run, "line_id long, feed string, reason string, detail string, fields array<string>")


def rejected(parsed: DataFrame) -> DataFrame:
    """Failing lines with their reason; comments are neither rows nor failures."""
    return parsed.where("reason IS NOT NULL AND reason <> 'comment'").select("line_id", "feed", "reason", "detail")


def loaded(parsed: DataFrame, name: str, feed: Feed) -> DataFrame:
    """Typed rows of one feed; empty values are null. ``unread`` lists valid values that their type can't hold (numbers of
    over 38 digits) as ``column=text``, so that none is lost."""
    value = lambda i: F.nullif(F.col("fields")[i], F.lit(""))
    typed = [(i, c, value(i).try_cast(feed.types.get(c, "string"))) for i, c in enumerate(feed.columns)]
    unread = F.concat_ws("; ", *[F.when(v.isNull() & value(i).isNotNull(), F.concat(F.lit(f"{c}="), value(i))) for i, c, v in typed if c in feed.types])
    return parsed.where(F.col("reason").isNull() & (F.col("feed") == name)).select("line_id", *[v.alias(c) for _, c, v in typed], F.nullif(unread, F.lit("")).alias("unread"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejected(parse_lines(spark.read.parquet(f"{sf_dir}/raw_lines.parquet"))).select("line_id", "reason")


def p3_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing lines with the edits that would mend them."""
    return rejected(parse_lines(spark.read.parquet(f"{sf_dir}/raw_lines.parquet")))


def _rows(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return loaded(parse_lines(spark.read.parquet(f"{sf_dir}/raw_lines.parquet")), name, FEEDS[name])

    return query


QUERIES = {"p3_found": p3_found, "p3_repairs": p3_repairs, "p3_monomers": _rows("monomer_library"), "p3_compounds": _rows("compound_final")}
