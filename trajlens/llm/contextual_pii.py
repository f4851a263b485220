"""Personal data by bootstrapped context: seeds induce patterns, patterns are scored, sure patterns find new identifiers.

Seeds are what fixed forms recognise (email, ip, card, phone). Every sighting of something identifier-like, a seed or not,
stands in lexical patterns made of the words around it. Patterns and distinct instances form a graph. A pattern is trusted
for a kind as far as its instances are known to be of it; an instance that no fixed form covers, but whose shape would
suit a kind, is believed as far as its patterns are trusted (noisy or). Believed instances strengthen patterns, and rounds
go on until none is added. What is only identifier-like counts against patterns, so chance neighbours earn no trust.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlens.llm.common import discard, keep, pieces, ship

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Context that patterns may look at, in code points, and longest part of an unseen address on each side of its @.
CONTEXT_CHARS = 64
ADDRESS_CHARS = 64
SALTS = 16
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that starts inside a longer run of digits has been tried already from the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SIGNS = re.compile("[0-9@]")
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\(?[0-9](?:[ ().\-/]{0,2}[0-9])++")
_COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_CODE = re.compile(r"[0-9][0-9A-Za-z]{3,}")
_EDGES = ".,;:!?()[]{}<>\"'"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(sign for sign in text if sign in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Addresses from each @ outwards, so that long runs without one cost nothing."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all fixed forms, sorted."""
    spans = [(start, EMAIL, end) for start, end in emails(text)]
    spans += [
        (m.start(), IP, m.end()) for m in _IP.finditer(text)
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m.group().split(".")))
    ]
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), CARD, m.end()))
    spans += [(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(spans)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Something on both sides of an @, whatever its signs."""
    at = text.find("@")
    while at >= 0:
        left = re.search(r"[^\s@]*\Z", text[max(0, at - ADDRESS_CHARS) : at]).group().lstrip(_EDGES)
        right = re.match(r"[^\s@]*", text[at + 1 : at + 1 + ADDRESS_CHARS]).group().rstrip(_EDGES)
        if any(map(str.isalnum, left)) and any(map(str.isalnum, right)):
            yield at - len(left), at + 1 + len(right)
        at = text.find("@", at + 1)


def other_sightings(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """(start, end, kinds its shape suits) of what is identifier-like and touches no fixed form; no kinds: only like one."""
    taken = bytearray(len(text))
    for start, _, end in base:
        taken[start:end] = b"\1" * (end - start)
    found: list[tuple[int, int, list[int]]] = []

    def offer(start: int, end: int, kinds: list[int]) -> None:
        if taken.find(1, start, end) < 0:
            taken[start:end] = b"\1" * (end - start)
            found.append((start, end, kinds))

    for start, end in _addresses(text):
        offer(start, end, [EMAIL])
    for m in _COLONS.finditer(text):
        offer(m.start(), m.end(), [IP])
    for m in _NUMBER.finditer(text):
        if text[m.end() : m.end() + 1].isalnum():
            continue
        size = len(_digits(m.group()))
        start = m.start() + (m.group().startswith("(") and ")" not in m.group())
        offer(start, m.end(), [kind for kind, low, high in ((CARD, 12, 19), (PHONE, 7, 15)) if low <= size <= high])
    for m in _CODE.finditer(text):
        if len(_digits(m.group())) >= 4:
            offer(m.start(), m.end(), [])
    return sorted(found)


def patterns(text: str, start: int, end: int) -> list[str]:
    """Words around a span: one and two before it, and one on each side. Digits are one sign, case is folded."""
    left = re.sub("[0-9]", "0", text[max(0, start - CONTEXT_CHARS) : start].lower())
    right = re.sub("[0-9]", "0", text[end : end + CONTEXT_CHARS].lower())
    before = left.split()[-2:]
    if left[-1:] and not left[-1].isspace():
        before[-1] += "|"
    before = ["^"] * (2 - len(before)) + before
    after = right.split(None, 1)[:1] or ["$"]
    if right[:1] and not right[0].isspace():
        after[0] = "|" + after[0]
    return [f"{before[1]} _", f"{before[0]} {before[1]} _", f"{before[1]} _ {after[0]}"]


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SIGHT = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("kinds", pa.list_(pa.int32())), ("instance", pa.string()),
    ("patterns", pa.list_(pa.string())),
])
_SCANNED = (
    "base array<struct<start:int,kind:int,end:int>>, "
    "sights array<struct<start:int,end:int,seed:int,kinds:array<int>,instance:string,patterns:array<string>>>"
)


def scan_text(text: str | None) -> tuple[list[dict], list[dict]]:
    if not text or not _SIGNS.search(text):
        return [], []
    base = base_spans(text)
    sights = [
        {"start": s, "end": e, "seed": kind, "kinds": [], "instance": f"{KINDS[kind]}:{text[s:e].lower()}", "patterns": patterns(text, s, e)}
        for s, kind, e in base
    ]
    sights += [
        {"start": s, "end": e, "seed": None, "kinds": kinds, "instance": f":{text[s:e].lower()}", "patterns": patterns(text, s, e)}
        for s, e, kinds in other_sightings(text, base)
    ]
    return [{"start": s, "kind": kind, "end": e} for s, kind, e in base], sights


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces([batch], "text"):
            base, sights = zip(*map(scan_text, part.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(base, pa.list_(_SPAN)), pa.array(sights, pa.list_(_SIGHT))], ["id", "base", "sights"]
            )


def scanned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row, id, base, sights`` of every row, written once; ``row`` tells rows of one id apart."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return keep(rows.mapInArrow(_scan, f"id {kind}, {_SCANNED}").withColumn("row", F.monotonically_increasing_id()))


def _per_kind(value) -> list[Column]:
    return [F.sum(value(kind).cast("long")).alias(f"known_{kind}") for kind in range(len(KINDS))]


def believed(sights: DataFrame, support: int = 3, pattern_trust: float = 0.7, belief: float = 0.9) -> DataFrame:
    """``instance, kind, belief`` of unseen identifiers.

    ``sights``: one row per sighting (seed, kinds, instance, patterns). A pattern counts for a kind with at least ``support``
    distinct known instances of it and a trust of known / (all distinct instances + 1) of at least ``pattern_trust``.
    """
    edges = keep(sights.select("instance", "seed", "kinds", F.explode("patterns").alias("pattern")).distinct())
    open_edges = keep(edges.where("seed is null and size(kinds) > 0").select("instance", "kinds", "pattern"))
    graph = edges.join(open_edges.select("pattern").distinct(), "pattern", "left_semi").groupBy("pattern").agg(
        F.count(F.lit(1)).alias("n"), *_per_kind(lambda kind: F.coalesce(F.col("seed") == kind, F.lit(False)))
    )
    graph = keep(graph)
    known: DataFrame | None = None
    size = 0
    while True:
        trusted = graph
        if known is not None:
            added = open_edges.join(known.select("instance", F.col("kind").alias("of")), "instance").groupBy("pattern").agg(
                *_per_kind(lambda kind: F.col("of") == kind)
            )
            names = [f"known_{kind}" for kind in range(len(KINDS))]
            added = added.withColumnsRenamed({name: f"more_{name}" for name in names})
            trusted = graph.join(added, "pattern", "left").select(
                "pattern", "n", *[(F.col(name) + F.coalesce(f"more_{name}", F.lit(0))).alias(name) for name in names]
            )
        trusted = trusted.select("pattern", "n", F.explode(F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.col(f"known_{kind}").alias("known")) for kind in range(len(KINDS))
        ])).alias("of")).select(
            "pattern", F.col("of.kind").alias("kind"), F.col("of.known").alias("known"), (F.col("of.known") / (F.col("n") + 1)).alias("trust")
        ).where((F.col("known") >= support) & (F.col("trust") >= pattern_trust))
        # A pattern may hold most instances: its one row is copied to every salt instead.
        salted = trusted.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        found = open_edges.select(
            "instance", "pattern", F.explode("kinds").alias("kind"), F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int").alias("salt")
        ).join(salted, ["pattern", "kind", "salt"]).groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("trust"))))).alias("belief")
        ).where(F.col("belief") >= belief).groupBy("instance").agg(F.max(F.struct("belief", -F.col("kind"))).alias("best"))
        found = keep(found.select("instance", (-F.col("best")["col2"]).alias("kind"), F.col("best")["belief"].alias("belief")))
        count = found.count()
        if known is not None:
            discard(known)
        known = found
        # Trust only grows with what is known, so the rounds end.
        if count == size:
            discard(edges, open_edges, graph)
            return known
        size = count


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits) -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, n_found, base (spans), found (spans), each span (start, kind, end).

    Every row gives one row, repeated and null ids too. A null or empty text has no spans. The counts are of fixed forms;
    ``found`` holds what context added, which never touches these. Spans are code points, end exclusive.
    """
    rows = scanned(docs, id_column, text_column)
    sights = rows.where("size(sights) > 0").select("row", F.explode("sights").alias("sight")).select("row", "sight.*")
    known = believed(sights.drop("row"), **limits).withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    open_sights = sights.where("seed is null and size(kinds) > 0").select(
        "row", "start", "end", "instance", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    # The spans of one text; their number is bounded by the text.
    found = open_sights.join(known, ["instance", "salt"]).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end")).alias("found")
    )
    nothing = F.array().cast(rows.schema["base"].dataType)
    out = rows.select("row", "id", "base").join(found, "row", "left").withColumn("found", F.coalesce("found", nothing))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda span: span["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return out.select(F.col("id").alias(id_column), *counts, F.size("found").cast("long").alias("n_found"), "base", "found")


def digests(found: DataFrame) -> DataFrame:
    """:func:`personal_data` with ``base_sha256`` and ``spans`` (all spans as kind:start:end) in place of the spans."""
    return found.withColumn("base_sha256", F.sha2(_text_of(F.col("base")).cast("binary"), 256)).withColumn(
        "spans", _text_of(F.concat("base", "found"))
    ).drop("base", "found")
