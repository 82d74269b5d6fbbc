"""N-gram Jaccard join (6): token-combination prefixes.

A document's set holds its distinct word shingles (64-bit hashes). Tokens seen
in many documents form the *frequent* class, all others the *rare* class; the
global order is rare before frequent, by hash within a class. With n tokens a
set may lose e = n - ceil(threshold * n) of them in a link. Its prefix is
extended until losing e tokens cannot destroy every signature: a rare token is a
signature alone; frequent tokens are dealt by hash into parts of about
``PART`` tokens, and in each part the pairs of prefix tokens are signatures, so a
part with m prefix tokens withstands m - 2 losses. Linked sets share a signature.
The number of parts follows the set's size; a set signs for each number of parts
that a partner's size allows, so both sides deal alike.

Equal sets form classes first. Signatures go by hash to buckets, where those
that two sets share are kept. Candidates are then verified on the exact sets in
rounds. A signature's head is the set with most shared signatures: the original
of edited copies rather than one of them. First every set meets the head it
shares most with; then, only for signatures whose sets are not yet in one
component, the head meets all others, then the smallest set does. Sets already
connected need no further check, so a large group of copies costs one check per set.
At last pairs in different components meet, but only those whose signatures outside their
own components leave a link possible: what a set shares with no other component is
lost in all links that are left. A pair of frequent tokens has a *level*, the number of
tokens that a prefix ending there withstands the loss of, plus one; two sets of known
sizes that share no rare token can lose few frequent ones, so they meet only at pairs of
low level in both. So the components are exact.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text of fewer words
than ``size`` is one shingle. Null and wordless texts have an empty set and link
with nothing. A null doc_id links with nothing and has no component. Rows that
share a doc_id are separate documents under one id. An empty table gives an
empty result. Texts of any length are read whole; other columns pass through
``keep_one``.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import arrow_schema, id_and_text, most_frequent, read_table, slices, written
from shelfspark.llm.graph import components
from shelfspark.llm.words import NOT_BLANK, Words, mixed
from shelfspark.session import Scratch

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Documents from which on a token counts as frequent; only the order depends on it, never the result.
FREQUENT = 32
#: Frequent tokens that are broadcast (8 bytes each), the most frequent first; the rest are ordered as rare.
FREQUENT_TOKENS = 1 << 20
#: Bytes of tokens that a counting task takes, about.
BUCKET_BYTES = 32 << 20
PART = 4
#: Members verified with one set in one group.
GROUP = 512
#: Bytes of texts that are cut into shingles at once; a longer text is a run of its own.
RUN_BYTES = 1 << 16
#: Higher levels are held as this one, which only lets more candidates through.
TOP_LEVEL = (1 << 16) - 1


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of a short array, faster than ``np.unique``."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, found for runs of texts that fit into a processor's cache."""
    sets, start, held = [], 0, 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > RUN_BYTES:
            sets += sets_of_run(texts[start:i], size)
            start, held = i, 0
        held += len(t)
    return sets + sets_of_run(texts[start:], size)


def sets_of_run(texts: list[bytes], size: int) -> list[np.ndarray]:
    """``shingle_sets`` of a few texts at once."""
    words = Words(texts, NOT_BLANK)
    count = np.bincount(words.text, minlength=len(texts)) if texts else np.zeros(0, np.int64)
    first, hashes = words.windows(size)
    bounds = np.searchsorted(words.text[first], np.arange(len(texts) + 1))
    sets = [distinct(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for n in set(count[(count > 0) & (count < size)].tolist()):
        first, hashes = words.windows(n)
        for i, h in zip(first.tolist(), hashes.tolist()):
            if count[words.text[i]] == n:
                sets[words.text[i]] = np.array([h], np.uint64)
    return sets


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for an equal set."""
    raw = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares with any partner, at least."""
    return -(-percent * n // 100)


def part_counts(n: int, percent: int) -> list[int]:
    """Numbers of parts for frequent tokens (powers of two) that a set of n tokens and its possible partners use."""
    def own(size: int) -> int:
        return 1 << max(0, (size // PART).bit_length() - 1)

    low, high = own(needed(n, percent)), own(100 * n // percent)
    return [1 << k for k in range(low.bit_length() - 1, high.bit_length())]


@lru_cache(maxsize=256)
def pairs_of(m: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of m places, the lower place first."""
    return np.triu_indices(m, 1)


def signatures(tokens: np.ndarray, frequent: np.ndarray, percent: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The rare tokens by which a sorted set signs, its other signatures, their levels, and whether its prefix holds rare tokens only
    (then these are not all its rare tokens); ``frequent`` holds sorted keys.

    The prefix that withstands the loss of k frequent tokens has the signatures up to level k + 1."""
    n, none = len(tokens), np.zeros(0, np.uint16)
    if not n:
        return tokens, tokens, none, True
    errors = n - needed(n, percent)
    if len(frequent):
        keys = token_keys(tokens, buckets)
        at = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
        often = frequent[at] == keys
        rare, common = tokens[~often], tokens[often]
    else:
        rare, common = tokens, tokens[:0]
    if len(rare) > errors:
        return rare[:errors + 1], tokens[:0], none, True
    out, levels, short = [tokens[:0]], [none.astype(np.int64)], errors + 1 - len(rare)
    for parts in part_counts(n, percent):
        part = (common >> np.uint64(7)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        # The position of a token inside its part: from the second on, each adds one loss that the part withstands.
        sorted_part = part[order]
        starts = np.flatnonzero(np.diff(sorted_part, prepend=sorted_part[:1] + np.uint64(1)))
        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        gain = np.zeros(len(common), np.int64)
        gain[order] = place > 0
        gain = np.cumsum(gain)
        enough = np.searchsorted(gain, short) + 1  # in the global order
        salt = mixed(np.array([parts], np.uint64))[0]
        if enough > len(common):  # too few tokens for pairs to be sure: here frequent tokens sign alone
            out.append(mixed(common[:short] ^ salt))
            levels.append(np.arange(1, len(out[-1]) + 1))
            continue
        prefix, part = common[:enough], part[:enough]
        for p in distinct(part):
            at = np.flatnonzero(part == p)
            if len(at) > 1:
                a, b = pairs_of(len(at))
                inside = prefix[at]
                out.append(mixed(inside[a] * np.uint64(3) + mixed(inside[b] ^ salt)))
                levels.append(gain[at[b]])
    found, level = np.concatenate(out), np.concatenate(levels)
    order = np.lexsort((level, found))
    found, level = found[order], np.minimum(level[order], TOP_LEVEL).astype(np.uint16)
    first = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=first[1:])
    return rare, found[first], level[first], False


def token_keys(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """What tokens are counted by: a bucket of their upper half, and their lower half."""
    return (tokens >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | tokens & np.uint64(0xFFFFFFFF)


def counted(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """From one scan of the texts: ``(key, n)`` of the tokens that at least ``FREQUENT`` documents hold, counted over all documents,
    and, where key is null, ``(doc_id, n, d1, d2)`` of every document, its set's size and digest.

    Tokens cross the shuffle as four bytes each, packed by bucket; the documents of a slice cross it in one row, dealt in turn."""
    blob_ddl = "bucket int, lower binary, doc_id array<long>, n array<long>, d1 array<long>, d2 array<long>"
    rows_ddl = "key long, n long, doc_id long, d1 long, d2 long"
    blob, rows = arrow_schema(blob_ddl), arrow_schema(rows_ddl)

    def scan(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)
                found = [digest(s) for s in sets]
                keys = np.sort(token_keys(np.concatenate(sets), buckets)) if sets else np.zeros(0, np.uint64)
                ends = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(ends)).tolist()
                lower = keys.astype(np.uint32)
                columns = {"bucket": [*used, turn % buckets], "lower": [*(lower[ends[b]:ends[b + 1]].tobytes() for b in used), b""]}
                documents = {"doc_id": part.column("doc_id").to_pylist(), "n": [len(s) for s in sets], "d1": [d for d, _ in found], "d2": [d for _, d in found]}
                columns |= {c: [*[None] * len(used), v] for c, v in documents.items()}
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in blob], schema=blob)

    def count(table: pa.Table) -> pa.Table:
        lower, n = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("lower").to_pylist()]), return_counts=True)
        often = n >= FREQUENT
        key = lower[often].astype(np.int64) | table.column("bucket")[0].as_py() << 32
        tokens = pa.table({"key": key, "n": pa.array(n[often], pa.int64())})
        documents = pa.table({c: pc.list_flatten(table.column(c)) for c in ("doc_id", "n", "d1", "d2")})
        both = pa.concat_tables([tokens, documents], promote_options="default")
        return pa.Table.from_arrays([both.column(f.name) for f in rows], schema=rows)

    return id_and_text(docs).mapInArrow(scan, blob_ddl).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, rows_ddl)


def shared_signatures(docs: DataFrame, frequent, size: int, buckets: int) -> DataFrame:
    """``(sig, doc_id, d1, plain, rare, level)`` for every signature that documents of different sets share; plain: the prefix is all rare;
    rare: the number of rare tokens the set signs by; level: 0 if the signature is such a token."""
    blob_ddl = "bucket int, sigs binary, at binary, level binary, ids binary, digests binary, plain binary, rare binary"
    rows_ddl = "sig long, doc_id long, d1 long, plain boolean, rare int, level int"
    blob, rows = arrow_schema(blob_ddl), arrow_schema(rows_ddl)

    def scan(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch):
                ids, sigs, levels = [], [], []
                for doc, tokens in zip(part.column("doc_id").to_pylist(), shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)):
                    key = digest(tokens)
                    if doc is None or not len(tokens) or key in seen:
                        continue  # copies inside a task sign once
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(key)
                    rare, others, level, plain = signatures(tokens, *frequent.value)
                    ids.append((doc, key[0], plain, len(rare)))
                    sigs += [rare, others]
                    levels += [np.zeros(len(rare), np.uint16), level]
                if not ids:
                    continue
                each = [len(s) for s in sigs]
                at = np.repeat(np.repeat(np.arange(len(ids), dtype=np.uint32), 2), each)
                flat, level = np.concatenate(sigs), np.concatenate(levels)
                bucket = (flat >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                flat, at, level = flat[order], at[order], level[order]
                ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
                ids = np.array(ids, np.int64)
                out = [[] for _ in blob]
                for b in range(buckets):
                    if ends[b] < ends[b + 1]:
                        mine = at[ends[b]:ends[b + 1]]
                        used, local = np.unique(mine, return_inverse=True)
                        for column, value in zip(out, (b, flat[ends[b]:ends[b + 1]].tobytes(), local.astype(np.uint32).tobytes(), level[ends[b]:ends[b + 1]].tobytes(),
                                                       ids[used, 0].tobytes(), ids[used, 1].tobytes(), ids[used, 2].astype(bool).tobytes(),
                                                       ids[used, 3].astype(np.int32).tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, blob)], schema=blob)

    def match(table: pa.Table) -> pa.Table:
        columns = {c: [np.frombuffer(v, kind) for v in table.column(c).to_pylist()] for c, kind in (
            ("sigs", np.uint64), ("at", np.uint32), ("level", np.uint16), ("ids", np.int64), ("digests", np.int64), ("plain", bool), ("rare", np.int32))}
        sigs, level = np.concatenate(columns["sigs"]), np.concatenate(columns["level"])
        docs_, digests, plain, rare = (np.concatenate([v[a] for v, a in zip(columns[c], columns["at"])]) for c in ("ids", "digests", "plain", "rare"))
        order = np.argsort(sigs, kind="stable")
        sigs, docs_, digests, plain, rare, level = (x[order] for x in (sigs, docs_, digests, plain, rare, level))
        starts = np.flatnonzero(np.diff(sigs, prepend=~sigs[:1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sigs))))
        differs = np.zeros(len(starts), bool)
        differs[group[digests != digests[starts][group]]] = True
        keep = differs[group]
        values = (sigs.view(np.int64), docs_, digests, plain, rare, level)
        return pa.Table.from_arrays([pa.array(v[keep], f.type) for v, f in zip(values, rows)], schema=rows)

    return (id_and_text(docs).mapInArrow(scan, blob_ddl)
            .repartition(buckets, "bucket").groupBy("bucket").applyInArrow(match, rows_ddl))


def alike_enough(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` whose shared signatures leave a link possible.

    Between two sets with prefixes of rare tokens, common tokens outside both
    prefixes are at most the larger set's tokens behind its prefix (one less than
    it needs), so the others must be shared signatures.
    """
    def side(x: str) -> DataFrame:
        return lists.select(F.col("rep").alias(x), F.col("d1").alias(f"{x}1"), F.col("marked.sig").alias(f"sigs_{x}"), F.col("plain").alias(f"plain_{x}"))

    total = F.ceil((F.col("m") + F.col("n")) * percent / (100 + percent))
    behind = F.ceil(F.greatest("m", "n") * percent / 100) - 1
    possible = ~(F.col("plain_a") & F.col("plain_b")) | (F.size(F.array_intersect("sigs_a", "sigs_b")) >= total - behind)
    return pairs.join(side("a"), ["a", "a1"]).join(side("b"), ["b", "b1"]).where(possible).select("a", "a1", "b", "b1")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b, a1, b1)`` whose sets link, told from ``docs(doc_id, text)``; a1 and b1 are the first halves of the sets' digests.

    The members b of a set a are dealt into groups of ``GROUP``, each with a copy of a's set.
    """
    sizes = pairs.groupBy("a", "a1").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    dealt = pairs.join(sizes, ["a", "a1"]).withColumn("part", F.pmod(F.xxhash64("b", "b1"), F.col("parts")).cast("int"))
    members = dealt.select("a", "a1", "part", F.col("b").alias("doc_id"), F.col("b1").alias("d1"), F.lit(False).alias("head"))
    heads = dealt.select("a", "a1", "part", F.col("a").alias("doc_id"), F.col("a1").alias("d1"), F.lit(True).alias("head")).distinct()
    texts = docs.join(members.unionAll(heads), "doc_id")
    out = "a long, a1 long, part int, head boolean, doc_id long, d1 long, tokens binary"
    schema, links = arrow_schema(out), arrow_schema("a long, b long")

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                found = shingle_sets([(t or "").encode() for t in part.column("text").to_pylist()], size)
                right = [digest(s)[0] == d for s, d in zip(found, part.column("d1").to_pylist())]
                kept = part.filter(pa.array(right, pa.bool_()))
                tokens = pa.array([s.tobytes() for s, ok in zip(found, right) if ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kept.column(f.name) for f in list(schema)[:-1]), tokens], schema=schema)

    def check(table: pa.Table) -> pa.Table:
        a, b, heads, rest = [], [], {}, []
        for row in table.select(["a", "head", "doc_id", "tokens"]).to_pylist():
            tokens = np.frombuffer(row["tokens"], np.uint64)
            if row["head"]:
                heads[row["a"]] = tokens
            else:
                rest.append((row["a"], row["doc_id"], tokens))
        for head, doc, tokens in rest:
            mine = heads[head]
            at = np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)
            both = int((mine[at] == tokens).sum())
            if 100 * both >= percent * (len(mine) + len(tokens) - both):
                a.append(head)
                b.append(doc)
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=links)

    return texts.mapInArrow(sets, out).groupBy("a", "a1", "part").applyInArrow(check, "a long, b long")


def enough_outside(percent: int) -> F.Column:
    """Whether two sets of different components that share the signature at hand can still link (columns of one end in ``_a``).

    ``out`` counts a set's signatures that other components share, ``out_alone`` the rare tokens among them. Common tokens of
    sets with prefixes of rare tokens are shared signatures or behind a prefix (see ``alike_enough``). A set with another
    prefix signs by all its ``rare`` tokens: what it shares with a prefix of rare tokens is a signature; with another such set
    it shares frequent tokens and rare ones that are signatures. If such two sets share no rare token, they
    lose at most their frequent tokens beyond ``total``: they meet at a pair in the prefixes that withstand this."""
    total = F.ceil((F.col("n_a") + F.col("n")) * percent / (100 + percent))

    def behind(n: F.Column) -> F.Column:
        return F.ceil(n * percent / 100) - 1

    plain, plain_a = F.col("plain"), F.col("plain_a")
    frequent = F.least(F.col("n") - F.col("rare"), F.col("n_a") - F.col("rare_a"))
    return (F.when(plain & plain_a, F.least("out", "out_a") >= total - behind(F.greatest("n", "n_a")))
            .when(plain | plain_a, F.least("out_alone", "out_alone_a") >= total - behind(F.when(plain, F.col("n")).otherwise(F.col("n_a"))))
            .when(F.least("level", "level_a") == 0, frequent + F.least("out_alone", "out_alone_a") >= total)
            .otherwise((F.col("level") <= F.col("n") - F.col("rare") - total + 1) & (F.col("level_a") <= F.col("n_a") - F.col("rare_a") - total + 1)))


def in_reach(percent: int) -> F.Column:
    """Whether a row's level leaves a link possible (see ``enough_outside``) with a set as small as the ``smallest`` at its signature."""
    partner = F.greatest("smallest", F.ceil(F.col("n") * percent / 100))
    total = F.ceil((F.col("n") + partner) * percent / (100 + percent))
    return F.col("plain") | (F.col("level") == 0) | (F.col("level") <= F.col("n") - F.col("rare") - total + 1)


def with_outside(now: DataFrame, percent: int) -> DataFrame:
    """The rows of signatures that several components share and that are in reach, with ``out`` and ``out_alone`` of their sets."""
    several = (now.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.min("n").alias("smallest"))
               .where("c0 < c1").select("sig", "smallest"))
    now = now.join(several, "sig").where(in_reach(percent)).drop("smallest")
    return now.join(now.groupBy("rep", "d1").agg(F.count(F.lit(1)).alias("out"), F.count_if(F.col("level") == 0).alias("out_alone")), ["rep", "d1"])


def one_per_group(now: DataFrame, *also: str) -> DataFrame:
    """Of the signatures whose sets are in several components, one for each different list of sets (told apart by two hash sums),
    with the columns ``also`` if they count for what is done there."""
    def summed(seed: int) -> F.Column:
        return F.sum(F.xxhash64(F.lit(seed), "rep", "d1", *also).cast("decimal(38,0)"))

    lists = now.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size"),
                                   summed(1).alias("s1"), summed(2).alias("s2")).where("c0 < c1")
    return lists.groupBy("size", "s1", "s2").agg(F.min("sig").alias("sig")).select("sig")


def last_meetings(now: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """All pairs of sets that share a signature where a link between their components is still possible, once for each such signature."""
    now = scratch.kept(with_outside(now, percent))
    now = scratch.kept(now.join(one_per_group(now, "level"), "sig"))
    other = now.select("sig", *[F.col(c).alias(f"{c}_a") for c in ("rep", "d1", "n", "c", "rare", "out", "out_alone", "plain", "level")])
    return other.join(now, "sig").where(enough_outside(percent)).select(
        F.col("rep_a").alias("a"), F.col("d1_a").alias("a1"), F.col("n_a").alias("m"), F.col("c_a").alias("ca"),
        F.col("rep").alias("b"), F.col("d1").alias("b1"), "n", "c")


def classes_and_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``."""
    if not 50 < percent <= 100:  # below, a set may be too small for pairs of tokens where its partner signs pairs only
        raise ValueError(f"percent is over 50 and at most 100, not {percent}")
    spark = docs.sparkSession
    total = id_and_text(docs).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, int(total) // BUCKET_BYTES)  # a word has about six bytes, a token takes four
    scan = written(counted(docs, size, buckets), "shingle-scan")
    often = most_frequent(scan.where("key IS NOT NULL"), FREQUENT_TOKENS).select("key").collect()  # 8 MB at most
    frequent = spark.sparkContext.broadcast((np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64)), percent, buckets))
    rows = scan.where("key IS NULL").select("doc_id", "n", "d1", "d2")
    linked = rows.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))

    scratch = Scratch(spark)
    try:
        ids = linked.select("doc_id", "d1", "d2").distinct().join(classes, ["d1", "d2"]).select("doc_id", "d1", "rep", "n")
        shared = shared_signatures(docs, frequent, size, buckets)
        lists = scratch.kept(shared.join(ids, ["doc_id", "d1"]).groupBy("rep", "d1").agg(
            F.collect_set(F.struct("sig", "level")).alias("marked"), F.first("n").alias("n"), F.first("plain").alias("plain"), F.first("rare").alias("rare")))
        member = lists.select("rep", "d1", "n", "plain", "rare", F.size("marked").alias("weight"), F.explode("marked").alias("s")).select("*", "s.*").drop("s")
        # Every round of verification reads texts by id: in buckets, they are shuffled once.
        texts = id_and_text(docs).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).repartition(shuffle, "doc_id")
        texts = spark.table(scratch.keep(texts, shuffle, ("doc_id",)))
        links, tried, component = None, None, None
        for step in range(4):
            if component is None:
                now = member.withColumn("c", F.col("rep"))
            else:
                now = (member.join(component.withColumnRenamed("node", "rep"), "rep", "left")
                       .select("sig", "level", "rep", "d1", "n", "plain", "rare", "weight", F.coalesce("component", "rep").alias("c")))
                if step < 3:
                    now = scratch.kept(now.join(one_per_group(now), "sig"))
            if step < 3:
                first = F.struct(F.lit(0).alias("weight") if step == 2 else -F.col("weight"), F.col("rep"))
                head = now.groupBy("sig").agg(F.min_by(F.struct("rep", "d1", "n", "c"), first).alias("h"))
                pairs = now.join(head, "sig").select(F.col("h.rep").alias("a"), F.col("h.d1").alias("a1"), F.col("h.n").alias("m"),
                                                     F.col("h.c").alias("ca"), F.col("rep").alias("b"), F.col("d1").alias("b1"), "n", "c")
            else:
                pairs = last_meetings(now, scratch, percent)
            fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
            once = F.col("a") < F.col("b") if step == 3 else F.col("a") != F.col("b")
            pairs = (pairs.where(once & (F.col("ca") != F.col("c")) & fits)
                     .groupBy("a", "a1", "m", "b", "b1", "n").agg(F.count(F.lit(1)).alias("common")))
            if step == 0:  # for each set the one it shares most with
                best = F.max_by(F.struct("a", "a1", "m", "n"), F.struct("common", -F.col("a"))).alias("h")
                pairs = pairs.groupBy("b", "b1").agg(best).select("h.a", "h.a1", "h.m", "h.n", "b", "b1")
            else:
                pairs = pairs.join(tried, ["a", "a1", "b", "b1"], "left_anti")
            pairs = scratch.kept(alike_enough(pairs, lists, percent))
            tried = pairs if tried is None else tried.unionAll(pairs)
            if pairs.isEmpty():
                continue
            good = scratch.kept(verified(texts, pairs, size, percent))
            links = good if links is None else links.unionAll(good)
            component = components(links)
        out = rows.join(classes.drop("n"), ["d1", "d2"], "left")
        own = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
        out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, own).otherwise(F.col("doc_id")).alias("rep"))
        if component is not None:
            out = out.join(component.withColumnRenamed("node", "rep"), "rep", "left").withColumn("rep", F.coalesce("component", "rep"))
        return written(out.select("doc_id", "n_shingles", F.col("rep").alias("component_id")), "jaccard-components")
    finally:
        scratch.close()


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all columns: of each component the document with the smallest id; rows without id stay."""
    gone, key = classes_and_components(docs, size, percent).where("component_id != doc_id"), f"id_{uuid.uuid4().hex}"
    gone = gone.select(F.col("doc_id").alias(key))
    return docs.join(gone, docs["doc_id"].cast("long") == gone[key], "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_and_components(read_table(spark, sf_dir, "documents"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLE = {"op6_jaccard_join": r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id AS origin, doc_id AS spot FROM doc
  UNION
  SELECT r.origin, l.b FROM reach r JOIN link l ON l.a = r.spot)
SELECT doc.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id
FROM doc LEFT JOIN size USING (doc_id)
JOIN (SELECT origin AS doc_id, min(spot) AS component_id FROM reach GROUP BY origin) c USING (doc_id)
"""}
