"""Record linkage of an extraction with a baseline: candidates by key, name and likeness, then one-to-one assignment.

Both sides need ``seq`` (unique) and the columns that the key is made of. Candidate joins are equi-joins with residual
conditions; assignment pairs the k-th row of a key with the k-th row of the other side, which is what a first-come
assignment gives, without a loop over rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoria.functions.similarity import indel_ratio
from scoria.functions.text import composite_key, normalize_name
from scoria.session import cut_lineage, place_within, ship_package

#: Score of a wildcard part, least likeness of names, least token-sort likeness.
WILDCARD_SCORE, LEAST_LIKENESS, LEAST_TOKEN_SORT = 0.3, 0.85, 0.85
#: Likenesses that are asked for first, from the highest: what has a counterpart so alike isn't compared with less alike ones.
ROUNDS = (0.93,)


def detect_scanner(df: DataFrame) -> str:
    """'openvas' or 'tenable' by the values of source, else by columns; one aggregate row is read."""
    if "source" in df.columns:
        s = F.upper("source")
        row = df.agg(F.bool_or(s == "OPENVAS").alias("o"), F.bool_or(s.isin("TENABLE", "NESSUS")).alias("t")).first()
        if row.o:
            return "openvas"
        if row.t:
            return "tenable"
    if "plugin" in df.columns:
        return "tenable"
    if "protocol" in df.columns and df.agg(F.count("protocol").alias("n")).first().n:
        return "openvas"
    return "generic"


def with_keys(df: DataFrame, scanner: str, ports: bool = True, columns: list[str] | None = None) -> DataFrame:
    """Adds ``name_norm`` and ``key``. ``columns``: those that both sides have, where they differ; a 'Services' row's key is made of them."""
    return df.withColumn("name_norm", normalize_name(F.col("Name"))).withColumn("key", composite_key(scanner, columns or df.columns, ports))


def exact_names(extraction: DataFrame, baseline: DataFrame) -> DataFrame:
    """The extraction's different normalised names, and whether the baseline has them: ``name_norm``, ``known``."""
    mine, theirs = extraction.select("name_norm").distinct(), baseline.select("name_norm").distinct().withColumn("__k", F.lit(True))
    return mine.join(theirs, "name_norm", "left").select("name_norm", F.col("__k").isNotNull().alias("known"))


def without_key(baseline: DataFrame, extraction: DataFrame) -> DataFrame:
    """Baseline rows whose key no extraction row has."""
    return baseline.join(extraction.select("key"), "key", "left_anti")


def dedup_baseline(baseline: DataFrame) -> DataFrame:
    """The first row of each normalised name."""
    rank = F.row_number().over(Window.partitionBy("name_norm").orderBy("seq"))
    return baseline.withColumn("__r", rank).filter("__r = 1").drop("__r")


def _parts(key: Column) -> Column:
    return F.split(key, r"\|")


def parts_score(a: Column, b: Column) -> Column:
    """Mean over the parts: 1 if equal, WILDCARD_SCORE if either is *, else 0. Arrays of one length."""
    one = F.zip_with(a, b, lambda x, y: F.when((x == "*") | (y == "*"), WILDCARD_SCORE).when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(one, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)


def wildcard_matches(extraction: DataFrame, baseline: DataFrame) -> DataFrame:
    """All pairs of distinct keys that agree where neither has a *: ``ext_key``, ``base_key``, ``base_seq``, ``score``.

    Joined on the number of parts and the first part; keys that begin with * are joined on the number of parts alone - on
    their few distinct keys only. The distinct keys of either side are read for each of these joins, and found once.
    """
    e = cut_lineage(extraction.select(F.col("key").alias("ext_key")).distinct()).withColumn("ep", _parts(F.col("ext_key"))).withColumn("n", F.size("ep")).withColumn("head", F.get("ep", F.lit(0)))
    b = cut_lineage(baseline.groupBy(F.col("key").alias("base_key")).agg(F.min("seq").alias("base_seq"))).withColumn("bp", _parts(F.col("base_key"))).withColumn("n", F.size("bp")).withColumn("head", F.get("bp", F.lit(0)))
    agree = F.forall(F.zip_with("ep", "bp", lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda x: x)
    out = ["ext_key", "base_key", "base_seq", parts_score(F.col("ep"), F.col("bp")).alias("score")]
    same = e.join(b, ["n", "head"]).filter(agree).select(*out)
    free_e = e.filter("head = '*'").join(b.filter("head <> '*'").drop("head"), "n").filter(agree).select(*out)
    free_b = e.filter("head <> '*'").drop("head").join(b.filter("head = '*'").drop("head"), "n").filter(agree).select(*out)
    return same.unionByName(free_e).unionByName(free_b)


def best_wildcard(extraction: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per extraction key the best baseline key: highest score, then the baseline's first."""
    rank = F.row_number().over(Window.partitionBy("ext_key").orderBy(F.desc("score"), "base_seq"))
    return wildcard_matches(extraction, baseline).withColumn("__r", rank).filter("__r = 1").drop("__r")


def _tokens(df: DataFrame) -> DataFrame:
    """Explodes ``__text`` to ``__token``: its pairs of neighbouring characters, each with its number among equal ones, so that they are a set. The other columns stay."""
    text = F.col("__text")
    pairs = F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))), lambda i: F.substring(text, i, 2)))
    kept = [c for c in df.columns if c != "__text"]
    each = df.select(*kept, F.explode_outer(pairs).alias("__pair")).groupBy(*kept, "__pair").agg(F.count(F.lit(1)).alias("__times"))
    return each.select(*kept, F.explode(F.sequence(F.lit(1), "__times")).alias("__i"), "__pair").select(*kept, F.concat("__pair", F.col("__i").cast("string")).alias("__token"))


def _least_shared(length: Column, least: float) -> Column:
    """Tokens that a text of this length surely shares with any text as alike as ``least``; 1 or more for all but short texts.

    Of T characters in both texts d <= (1 - least) * T are edits, and (T - d) / 2 common; each edit makes at most one new
    pair of neighbours, so (T - d) / 2 - 1 - d pairs are shared, and T is at least length * 2 / (2 - least).
    """
    return F.ceil(length * (2.0 * (1.5 * least - 1.0) / (2.0 - least)) - 1.0 - 1e-9).cast("int")


#: Characters whose numbers in two texts are compared before the texts are: 32 kinds, each counted up to 8, in 4 numbers of 64 bits.
KINDS = (*(f"{c}{c.upper()}" for c in "abcdefghijklmnopqrstuvwxyz"), "0123456789", " ", "-_", ".,", "/:", "()")


def _bags(text: Column) -> dict[str, Column]:
    """How many characters of each of the KINDS a text has, as so many bits, 8 for each kind."""
    def bits(kind: str) -> Column:
        n = F.length(text) - F.length(F.translate(text, kind, ""))
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(n, F.lit(8))) - 1

    words = [[F.shiftleft(bits(kind), 8 * i) for i, kind in enumerate(KINDS[w : w + 8])] for w in range(0, len(KINDS), 8)]
    return {f"__bag{i}": reduce(Column.bitwiseOR, word) for i, word in enumerate(words)}


def fuzzy_names(names: DataFrame, candidates: DataFrame, least: float = LEAST_LIKENESS, block: str | None = None, likeness: Callable[[Column, Column], Column] = indel_ratio, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per name (``name``) the most alike candidate (``candidate``, ``rank``): ``name``, ``candidate``, ``score``; ties to the lower rank.

    ``likeness`` is the indel ratio of the names in their ``form`` (as they are, if none). With ``block``, only names of
    the same block are compared. No pair that is as alike as ``least`` is missed, and not all pairs are made: a text's pairs
    of neighbouring characters are put in order of their rarity, and texts meet by the rarest of them only, as many as it
    takes for two texts so alike to have one in common. Very alike counterparts are sought first, by few and rare ones (see
    ROUNDS); only names without any go on. Short texts, of which nothing is sure, meet by single characters. Texts that meet
    are compared only if the numbers of their characters (see KINDS) differ by no more than the edits between texts so alike.
    Both sides are distinct names; empty names have no counterpart.
    """
    by = [block] if block else []
    form = form or (lambda c: c)
    a = names.select(F.lit(0).alias("__side"), "name", F.lit(None).cast(candidates.schema["rank"].dataType).alias("rank"), *by).distinct()
    b = candidates.groupBy(F.lit(1).alias("__side"), "name", *by).agg(F.min("rank").alias("rank")).select("__side", "name", "rank", *by)
    # both sides are read several times; from here to the scores texts go by their number
    every = cut_lineage(a.unionByName(b).filter("name <> ''").withColumn("__text", form(F.col("name"))).withColumn("__id", F.monotonically_increasing_id()))
    each = _tokens(every.select("__id", *by, "__text"))
    rarity = each.filter("__token IS NOT NULL").groupBy(*by, "__token").agg(F.count(F.lit(1)).alias("__n"))
    tokens = F.transform(F.array_sort(F.collect_list(F.when(F.col("__token").isNotNull(), F.struct("__n", "__token")))), lambda s: s["__token"])
    # each text with its tokens, the rarest first
    ordered = each.join(rarity, [*by, "__token"], "left").groupBy("__id").agg(tokens.alias("__tokens"))
    # tokens are many times the texts that the optimiser knows the size of: without the hint it may broadcast them
    ordered = cut_lineage(every.join(ordered.hint("merge"), "__id").withColumn("__length", F.length("__text")).withColumns(_bags(F.col("__text"))))
    a = ordered.filter("__side = 0").drop("__side", "rank")
    b = ordered.filter("__side = 1").drop("__side").withColumnRenamed("name", "candidate")
    found = None
    for at_least in sorted({least, *(r for r in ROUNDS if r > least)}, reverse=True):
        best = _most_alike(a, b, at_least, by, likeness)
        if at_least > least:
            best = cut_lineage(best)
            a = a.join(best.select("name", *by), ["name", *by], "left_anti")
        found = best if found is None else found.unionByName(best)
    return found


def _most_alike(a: DataFrame, b: DataFrame, least: float, by: list[str], likeness: Callable[[Column, Column], Column]) -> DataFrame:
    """Per name of ``a`` the most alike of ``b``, if it is as alike as ``least``."""
    longest = int(2.0 / (2.0 * (1.5 * least - 1.0) / (2.0 - least)) + 1) if least > 2 / 3 else 1 << 30
    partner = longest * (2.0 - least) / least if least > 2 / 3 else 1 << 30

    def keys(df: DataFrame) -> DataFrame:
        """The rarest tokens of a text; its characters too, if it or its counterpart may be short."""
        size = F.size("__tokens")
        rare = F.slice("__tokens", 1, F.greatest(size - F.greatest(_least_shared(F.col("__length"), least), F.lit(1)) + 1, F.lit(0)))
        letters = F.when(F.col("__length") <= partner, F.array_distinct(F.split("__text", ""))).otherwise(F.array().cast("array<string>"))
        return df.select("__id", *by, "__length", *bags, F.explode(F.concat(rare, letters)).alias("__key"))

    bags = [c for c in a.columns if c.startswith("__bag")]
    x = keys(a).withColumnsRenamed({"__id": "__idx", "__length": "__lx", **{c: f"{c}x" for c in bags}})
    y = keys(b).withColumnsRenamed({"__id": "__idy", "__length": "__ly", **{c: f"{c}y" for c in bags}})
    # the ratio is at most 2 * min / (both lengths); single characters count for short texts only
    near = 2.0 * F.least("__lx", "__ly") >= least * (F.col("__lx") + F.col("__ly")) - 1e-9
    useful = (F.length("__key") > 1) | (F.least("__lx", "__ly") <= longest)
    # each edit changes the number of one character by one
    edits = reduce(Column.__add__, (F.bit_count(F.col(f"{c}x").bitwiseXOR(F.col(f"{c}y"))) for c in bags))
    near = near & (edits <= (1.0 - least) * (F.col("__lx") + F.col("__ly")) + 1e-6)
    met = x.join(y, [*by, "__key"]).filter(near & useful).select("__idx", "__idy").distinct()
    pairs = met.join(a.select(F.col("__id").alias("__idx"), "name", *by, F.col("__text").alias("__x")), "__idx")
    pairs = pairs.join(b.select(F.col("__id").alias("__idy"), "candidate", "rank", F.col("__text").alias("__y")), "__idy")
    scored = pairs.withColumn("score", likeness(F.col("__x"), F.col("__y")))
    # a filter of pairs by their score would be moved before distinct and score each pair as often as it meets, and then again
    best = F.max_by(F.struct("candidate", "score"), F.struct(F.col("score"), (-F.col("rank")).alias("r")))
    return scored.groupBy("name", *by).agg(best.alias("b")).select("name", "b.candidate", *by, "b.score").filter(F.col("score") >= least)


def resolve(extraction: DataFrame, baseline: DataFrame, least: float = LEAST_LIKENESS) -> DataFrame:
    """Each extraction row with its match: adds ``match_key`` (from the key, else null), ``match_name``, ``match_score``, ``status``.

    In order: key (wildcards count), exact name, alike name, none. What one name resolves to holds for all its rows: the
    last row's match decides (``match_name``); the key's match is each row's own. Exact names are looked up before likeness
    is computed for the rest. ``match_score`` is the likeness of both names, 0 without a match.
    """
    best = best_wildcard(extraction, baseline).select("ext_key", "base_key")
    names = baseline.groupBy("name_norm").agg(F.min("seq").alias("rank"))
    base_of_key = baseline.groupBy(F.col("key").alias("base_key")).agg(F.max_by("name_norm", "seq").alias("key_name"))
    keyed = extraction.join(best.join(base_of_key, "base_key"), extraction["key"] == best["ext_key"], "left").drop("ext_key")
    # the search for alike names and what follows it read these rows
    keyed = cut_lineage(keyed.join(names.select("name_norm", F.lit(True).alias("exact")), "name_norm", "left").select(*extraction.columns, "base_key", "key_name", "exact"))
    rest = keyed.filter("exact IS NULL AND name_norm <> ''").select(F.col("name_norm").alias("name"))
    alike = fuzzy_names(rest, names.select(F.col("name_norm").alias("name"), "rank"), least).select(F.col("name").alias("__alike_name"), "candidate")
    own = keyed.join(alike, keyed["name_norm"] == alike["__alike_name"], "left").drop("__alike_name")
    own = own.withColumn("own_name", F.when(F.col("base_key").isNotNull(), F.col("key_name")).when(F.col("exact"), F.col("name_norm")).otherwise(F.col("candidate")))
    own = cut_lineage(own.select(*extraction.columns, "base_key", "exact", "own_name"))
    last = own.groupBy(F.col("name_norm").alias("__name")).agg(F.max_by("own_name", "seq").alias("match_name"))
    scored = last.withColumn("match_score", F.coalesce(indel_ratio(F.col("__name"), F.col("match_name")), F.lit(0.0)))
    out = own.join(scored, own["name_norm"] == scored["__name"], "left")
    status = F.when(F.col("base_key").isNotNull(), "MATCHED_COMPOSITE").when(F.col("match_name").isNull(), "UNMATCHED").when(F.col("exact"), "MATCHED_NAME_ONLY").otherwise("MATCHED_FUZZY")
    return out.select(*extraction.columns, F.col("base_key").alias("match_key"), "match_name", "match_score", status.alias("status"))


def assign_by_key(extraction: DataFrame, baseline: DataFrame, left: str = "match_key", right: str = "key") -> DataFrame:
    """The k-th extraction row of a key with the k-th baseline row of that key: ``ext_seq``, ``base_seq`` (null: more rows than the baseline has)."""
    e = extraction.filter(F.col(left).isNotNull()).select(F.col(left).alias("k"), F.col("seq").alias("ext_seq"))
    b = baseline.select(F.col(right).alias("k"), F.col("seq").alias("base_seq"))
    # both sides are put in order at once, and the k-th rows of both meet in one group
    both = e.select("k", F.lit(0).alias("side"), F.col("ext_seq").alias("s")).unionByName(b.select("k", F.lit(1).alias("side"), F.col("base_seq").alias("s")))
    placed = place_within(both, ["k", "side"], ["s"], "n")
    ext_seq, base_seq = (F.max(F.when(F.col("side") == side, F.col("s"))) for side in (0, 1))
    return placed.groupBy("k", "n").agg(ext_seq.alias("ext_seq"), base_seq.alias("base_seq")).filter("ext_seq IS NOT NULL").select("ext_seq", "base_seq")


def _take_in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows name by name, each name's free rows (not ``asks``) first: a row takes the first free one with its port and protocol, else with one of them, else any.

    Free rows wait in one queue for each of these, in their order; what was taken from another queue is passed over, so the
    work follows the rows of both sides together, however many names there are.
    """
    of = None
    queues: dict[tuple, deque] = {}
    taken: set[int] = set()

    def first(q: tuple) -> int | None:
        waiting = queues.get(q, ())
        while waiting and waiting[0] in taken:
            waiting.popleft()
        return waiting[0] if waiting else None

    for batch in batches:
        out = []
        for name, asks, seq, port, protocol in zip(batch["name"], batch["asks"], batch["seq"], batch["port"], batch["protocol"]):
            if name != of:
                of = name
                queues.clear()
                taken.clear()
            if not asks:
                for q in ((port, protocol), ("port", port, 0), ("protocol", protocol, 0), ()):
                    queues.setdefault(q, deque()).append(seq)
                continue
            got = first((port, protocol)) if port and protocol else None
            if got is None:
                ones = [first(q) for q, said in ((("port", port, 0), port), (("protocol", protocol, 0), protocol)) if said]
                got = min((x for x in ones if x is not None), default=None)
            if got is None:
                got = first(())
            if got is not None:
                taken.add(got)
            out.append((seq, got))
        yield pd.DataFrame(out, columns=["ext_seq", "base_seq"]).astype({"ext_seq": "int64", "base_seq": "Int64"})


def _best_by(rate: Callable[[dict, dict], float]) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def greedy(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = right.sort_values("base_seq").to_dict("records")
        out = []
        for e in left.sort_values("ext_seq").to_dict("records"):
            best = max(range(len(free)), key=lambda i: (rate(e, free[i]), -i), default=None)
            out.append((e["ext_seq"], free.pop(best)["base_seq"] if best is not None else None))
        return pd.DataFrame(out, columns=["ext_seq", "base_seq"]).astype({"base_seq": "Int64"})

    return greedy


def mean_field_score(fields: list[str], score: Callable[[str, str], float]) -> Callable[[dict, dict], float]:
    """A rate for assign_fallback: the mean score of the fields that both rows have, and 0.5 more if port and protocol are equal; -1 if there is no such field."""
    seen: dict[tuple[str, str], float] = {}

    def rate(e: dict, b: dict) -> float:
        scores = []
        for f in fields:
            x, y = e[f] or "", b[f] or ""
            if x.strip() and y.strip():
                if (x, y) not in seen:
                    seen[x, y] = score(x, y)
                scores.append(seen[x, y])
        return sum(scores) / len(scores) + 0.5 * (e["port"] == b["port"] and e["protocol"] == b["protocol"]) if scores else -1.0

    return rate


def assign_fallback(rows: DataFrame, free: DataFrame, score: Callable[[dict, dict], float] | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Rows (``ext_seq``, ``name``, ``port``, ``protocol``) take, in order, the best free baseline row of their name.

    The best has the highest score - by default one for an equal port and one for an equal protocol - and comes first on a
    tie; a taken row is gone. Names don't share rows, so each name is one group, of the narrow rows that the key left over;
    with the default score the work follows their number. Another ``score`` of two rows (with the columns ``fields``)
    compares each row with all free rows of its name. ``ext_seq``, ``base_seq`` (null: none left).
    """

    def tidy(df: DataFrame, seq: str) -> DataFrame:
        return df.select("name", F.trim(F.coalesce("port", F.lit(""))).alias("port"), F.lower(F.trim(F.coalesce("protocol", F.lit("")))).alias("protocol"), F.col(seq), *fields)

    ship_package(rows.sparkSession)
    rows, free, out = tidy(rows, "ext_seq"), tidy(free, "base_seq"), "ext_seq bigint, base_seq bigint"
    if score:
        return rows.groupBy("name").cogroup(free.groupBy("name")).applyInPandas(_best_by(score), out)
    both = free.withColumnRenamed("base_seq", "seq").withColumn("asks", F.lit(False)).unionByName(rows.withColumnRenamed("ext_seq", "seq").withColumn("asks", F.lit(True)))
    return both.repartition("name").sortWithinPartitions("name", "asks", "seq").mapInPandas(_take_in_order, out)


@dataclass(frozen=True)
class Linkage:
    """What linking gives: ``links`` (``ext_seq``, ``base_seq``, ``status``), the extraction's ``resolved`` rows and the ``baseline`` rows that took part, both with keys."""

    links: DataFrame
    resolved: DataFrame
    baseline: DataFrame


def link_steps(extraction: DataFrame, baseline: DataFrame, scanner: str | None = None, allow_duplicates: bool = False, ports: bool = True, score: Callable[[dict, dict], float] | None = None, fields: tuple[str, ...] = (), along: tuple[str, ...] = ()) -> Linkage:
    """The whole linkage: each extraction row with its baseline row and status, and baseline rows never used as ABSENT.

    ``score`` and ``fields`` (text columns of both sides) decide among baseline rows of one name, see assign_fallback.
    ``along``: other columns of both sides that ``resolved`` and ``baseline`` shall have.
    """
    scanner = scanner or detect_scanner(extraction)
    shared = [c for c in extraction.columns if c in baseline.columns]
    e, b = with_keys(extraction, scanner, ports, shared), with_keys(baseline, scanner, ports, shared)
    if not allow_duplicates:
        b = dedup_baseline(b)
    # several steps read what follows: both sides are cut to their narrow columns
    narrow = dict.fromkeys(("seq", "Name", "key", "name_norm", "port", "protocol", *fields, *along))
    e, b = (cut_lineage(_column(_column(x, "port"), "protocol").select(*narrow)) for x in (e, b))
    resolved = cut_lineage(resolve(e, b))
    by_key = cut_lineage(assign_by_key(resolved, b))
    used = by_key.filter("base_seq IS NOT NULL").select("base_seq")
    free = b.join(used, b["seq"] == used["base_seq"], "left_anti").select(F.col("name_norm").alias("name"), "port", "protocol", F.col("seq").alias("base_seq"), *fields)
    rest = resolved.filter("match_key IS NULL AND match_name IS NOT NULL").select(F.col("match_name").alias("name"), "port", "protocol", F.col("seq").alias("ext_seq"), *fields)
    assigned = cut_lineage(by_key.unionByName(assign_fallback(rest, free, score, fields)))
    status = F.when(F.col("r.status") == "UNMATCHED", "UNMATCHED").when(F.col("a.base_seq").isNull(), "UNMATCHED_EXCESS").otherwise(F.col("r.status"))
    rows = resolved.alias("r").join(assigned.alias("a"), F.col("r.seq") == F.col("a.ext_seq"), "left").select(F.col("r.seq").alias("ext_seq"), "a.base_seq", status.alias("status"))
    absent = b.select(F.col("seq").alias("base_seq")).join(assigned.filter("base_seq IS NOT NULL").select("base_seq"), "base_seq", "left_anti")
    links = cut_lineage(rows.unionByName(absent.select(F.lit(None).cast("bigint").alias("ext_seq"), "base_seq", F.lit("ABSENT").alias("status"))))
    return Linkage(links, resolved, b)


def _column(df: DataFrame, name: str) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast("string"))


def link(extraction: DataFrame, baseline: DataFrame, scanner: str | None = None, allow_duplicates: bool = False, ports: bool = True) -> DataFrame:
    """``ext_seq``, ``base_seq``, ``status`` of every extraction row, and of baseline rows never used as ABSENT; see link_steps."""
    return link_steps(extraction, baseline, scanner, allow_duplicates, ports).links


def mapping_debug(linkage: Linkage) -> DataFrame:
    """How each extraction row was matched: its names and key, the baseline's name, likeness of both names and the kind of match."""
    first = linkage.baseline.groupBy(F.col("name_norm").alias("match_name")).agg(F.min_by("Name", "seq").alias("Baseline_Name_matched"))
    kind = F.when(F.col("match_name").isNull(), "UNMATCHED").when(F.col("match_key").isNotNull(), "MATCHED_COMPOSITE").otherwise("MATCHED_NAME_ONLY")
    rows = linkage.resolved.join(first, "match_name", "left")
    return rows.select("seq", F.col("Name").alias("Extraction_Name"), F.col("name_norm").alias("Extraction_Name_norm"), F.col("key").alias("Composite_Key"), "Baseline_Name_matched", F.coalesce("match_score", F.lit(0.0)).alias("match_score"), kind.alias("Status"))


def lookup_with_alternative(df: DataFrame, dim: DataFrame, key: str, alternative: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing): ``value`` of the first of two keys that ``dim`` (``key``, ``value``; unique keys) has."""
    one = dim.select(F.col("key").alias(key), F.col("value").alias("__v1"))
    two = dim.select(F.col("key").alias(alternative), F.col("value").alias("__v2"))
    joined = df.join(one, key, "left").join(two, alternative, "left").withColumn(value, F.coalesce("__v1", "__v2")).drop("__v1", "__v2")
    return joined.filter(F.col(value).isNotNull()), joined.filter(F.col(value).isNull()).drop(value)


def model_cascade(file_key: Column, models: list[tuple[str, str]]) -> Column:
    """A file key's model of (model, alias): alias within the key, a part equal to the name, a part's beginning, the name within; else 'unknown'.

    The models are settings; the first rule that fits any model wins, then the longer alias, then the name.
    """
    parts = F.split(file_key, "_")
    ordered = sorted(models, key=lambda m: (-len(m[1]), m[0]))
    rules: list[Callable[[str, str], Column]] = [
        lambda m, a: file_key.contains(a),
        lambda m, a: F.array_contains(parts, m),
        lambda m, a: F.exists(parts, lambda p: p.startswith(m)),
        lambda m, a: file_key.contains(m),
    ]
    return F.coalesce(*(F.when(rule(m, a), m) for rule in rules for m, a in ordered), F.lit("unknown"))


def experiment_plan(baselines: DataFrame, reports: DataFrame, scanners: list[str], models: list[str], runs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(plan, baselines without report, reports without baseline) by ``base``: one row per pair, scanner, model and run, with a ``run_id`` of all four."""
    pairs = baselines.select("base").distinct().join(reports.select("base").distinct(), "base")
    plan = pairs.select("base", F.explode(F.array(*map(F.lit, scanners))).alias("scanner"))
    plan = plan.select("*", F.explode(F.array(*map(F.lit, models))).alias("llm")).select("*", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run_num"))
    plan = plan.withColumn("run_id", F.concat_ws("__", "base", "scanner", "llm", F.concat(F.lit("run"), F.col("run_num").cast("string"))))
    return plan, baselines.join(reports, "base", "left_anti"), reports.join(baselines, "base", "left_anti")


def unfinished(plan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned runs whose latest ledger row isn't 'ok'."""
    done = latest_runs(ledger).filter(F.lower(F.trim("status")) == "ok").select("run_id")
    return plan.join(done, "run_id", "left_anti")


def latest_runs(ledger: DataFrame) -> DataFrame:
    """The last row of each run by run_at; one aggregation with map-side combine."""
    row = F.struct(*(F.col(f"`{c}`") for c in ledger.columns))
    return ledger.groupBy("run_id").agg(F.max_by(row, F.struct("run_at", "status")).alias("r")).select("r.*")


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Per ``item`` the first (by ``priority``) of its candidate ``path`` that exists."""
    found = candidates.join(existing.select("path").distinct(), "path", "left_semi")
    return found.groupBy("item").agg(F.min_by("path", "priority").alias("path"))


def blocked_token_sort(rows: DataFrame, baseline: DataFrame, least: float = LEAST_TOKEN_SORT) -> DataFrame:
    """Each row's name (``ip``, ``name``) as the most alike baseline name of the same address, or as it is; rows keep their number.

    Names are compared with their words in order, so the same candidates as in fuzzy_names do, within an address.
    """

    def in_order(name: Column) -> Column:
        return F.array_join(F.array_sort(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != "")), " ")

    # of equally alike names the first in order
    distinct = baseline.select("ip", "name").distinct()
    cands = distinct.withColumn("rank", F.row_number().over(Window.partitionBy("ip").orderBy("name")))
    best = fuzzy_names(rows.select("ip", "name"), cands, least, "ip", indel_ratio, in_order)
    return rows.join(best.select("ip", "name", "candidate"), ["ip", "name"], "left").withColumn("matched_name", F.coalesce("candidate", "name")).drop("candidate")
