"""N-gram Jaccard join on parity sketches.

A text's sketch is the XOR of one bit for each of its shingles, so the bits in which two sketches differ
number no more than the shingles in which the texts do. A link of sizes a and b allows at most
d = floor((a + b) * (1 - J) / (1 + J)) of those. For each band of sizes the long sketch is cut into n > d parts, of which a
text fills some f; a pair within d agrees on at least f - d parts that are not empty, so the d + 1 parts that come first in any
order common to all texts hold one of them (pigeonhole, as prefix filtering has it); there are so many parts that f > d all but
always. Parts with most shingles come first:
a passage that many texts share seldom fills such a part alone. A part is sent as the XOR of its
shingles' hashes with the text's id. Texts that agree on a part are compared by a short dense sketch, and
those that may link are verified on their texts. Equal shingle sets are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ASCII_SPACE, ROW, U64, SlotFilter, Words, buffers, deltas, down, ids, join_about, keyed, mapped, mix, pack, partitions_for, scaled, steps, stored, text_bytes, unpack, up

SHINGLE = 5
#: Similarity as a fraction: num / den.
NUM, DEN = 80, 100
#: Part entries that a task gathers before it sorts and sends them.
RUN_PARTS = 500_000
#: Larger groups of texts that agree on a part are compared in blocks of this many.
BLOCK = 2_000
#: Logarithm of the chance, at most, that a text fills too few parts for the pigeonhole argument.
UNFILLED = math.log(1e-12)
#: Bits of the dense sketch: a power of two, at least twice as many as the text has shingles, between these.
LEAST_BITS, MOST_BITS = 64, 8_192


# ---------------------------------------------------------------- sets


class Sets:
    """Distinct shingles of a run of texts: sorted hashes, grouped by text."""

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        words = Words(*buffers(column), ASCII_SPACE, fold=True)
        h = words.hashes()
        runs = words.windows(h, shingle)
        whole = np.flatnonzero(words.text[: len(runs)] == words.text[shingle - 1 :][: len(runs)])
        text, key = [words.text[whole]], [runs[whole]]
        for k in range(1, shingle):  # shorter texts are one shingle
            few = np.flatnonzero(words.count == k)
            if len(few):
                text.append(few)
                key.append(mix(words.windows(h, k)[words.bound[few]], 100 + k))
        text, key = np.concatenate(text), np.concatenate(key)
        order = np.argsort(key)
        order = order[np.argsort(text[order].astype(np.uint16) if len(words.count) < 65_536 else text[order], kind="stable")]
        text, key = text[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        self.key, self.text = key[new], text[new]
        self.size = np.bincount(self.text, minlength=len(words.count))
        self.bound = np.concatenate([[0], np.cumsum(self.size)])

    def of(self, k: int) -> np.ndarray:
        return self.key[self.bound[k] : self.bound[k + 1]]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of one value for each shingle, by text."""
        total = np.concatenate([np.zeros(1, U64), np.cumsum(values, dtype=U64)])
        with np.errstate(over="ignore"):
            return total[self.bound[1:]] - total[self.bound[:-1]]

    def sketches(self) -> list[bytes]:
        """Dense parity sketches; the bits of a text are a power of two that its size decides."""
        bits = sketch_bits(self.size)
        place = (mix(self.key, 3) & (bits[self.text] - 1).astype(U64)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(bits)])
        parity = np.zeros(int(first[-1]), np.uint8)
        np.bitwise_xor.at(parity, first[self.text] + place, 1)
        packed = np.packbits(parity).tobytes()
        return [packed[a // 8 : b // 8] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def sketch_bits(size: np.ndarray) -> np.ndarray:
    return np.clip(2 ** np.ceil(np.log2(2 * np.maximum(size, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)


def _allowed(total: np.ndarray) -> np.ndarray:
    """Most shingles in which two linked texts with so many in all can differ."""
    return total * (DEN - NUM) // (DEN + NUM)


# ---------------------------------------------------------------- parts


def _bands(most: int) -> np.ndarray:
    """Largest size of each band: a text links with others of its own band and the two beside it only."""
    top = [1]
    while top[-1] < most:
        top.append(max(top[-1] + 1, top[-1] * DEN // NUM))
    top.append(max(top[-1] + 1, top[-1] * DEN // NUM))
    return np.array(top, np.int64)


def _part_counts(top: np.ndarray) -> np.ndarray:
    """Parts of each scheme: about 1.3 for each difference that it allows, and for small sets as many more as it takes that a
    text all but never (UNFILLED) fills too few: by the union bound, C(n, most) * (most / n) ** least size. In the smallest schemes a
    part then holds a single shingle, which is prefix filtering."""
    least, following = np.append(1, top[:-2] + 1), top[1:]
    out = []
    for size, most in zip(least.tolist(), _allowed(top[:-1] + following).tolist()):
        n = (most + 1) * 13 // 10 + 3
        while most and math.lgamma(n + 1) - math.lgamma(most + 1) - math.lgamma(n - most + 1) + size * math.log(most / n) > UNFILLED:
            n += 1 + n // 16
        out.append(n)
    return np.array([*out, out[-1]], np.int64)


def _parts(sets: Sets, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts that each text sends, and its id with 1 in the last bit where it is of the upper band."""
    if not len(sets.key):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    top = _bands(int(sets.size.max()))
    counts = _part_counts(top)
    band = np.searchsorted(top, sets.size)
    keys, owners = [], []
    for upper in (0, 1):  # parts of the text's own band, and those of the band below for its smaller partners
        scheme = np.maximum(band - upper, 0)
        most = _allowed(top[scheme] + top[scheme + 1])
        partner = sets.size if upper else sets.size * DEN // NUM  # the largest that a link allows
        need = np.minimum(most, _allowed(sets.size + partner)) + 1
        used = (sets.size > 0) & (need > 1) & (band >= upper)
        n = counts[scheme]
        at = np.flatnonzero(used[sets.text])
        text, h = sets.text[at], sets.key[at]
        part = scaled(mix(h, 11), n[text])
        group = (text.astype(U64) << U64(32)) | part
        order = np.argsort(group, kind="stable")
        group, h = group[order], mix(h[order], 12)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(group)))
        fold = np.bitwise_xor.reduceat(h, first) if len(first) else h
        text, part = (group[first] >> U64(32)).astype(np.int64), group[first] & U64(0xFFFFFFFF)
        filled = np.bincount(text, minlength=len(doc))
        with np.errstate(over="ignore"):
            place = mix(part + (scheme[text].astype(U64) << U64(32)), 13)
            key = mix(fold + place, 14)
        order = np.lexsort((key, -count, text))  # most shingles first, then by hash
        rank = np.empty(len(order), np.int64)
        start = np.concatenate([[0], np.cumsum(filled)])
        rank[order] = np.arange(len(order)) - start[text[order]]
        send = rank < need[text]
        keys.append(key[send])
        owners.append(doc[text[send]] * 2 + upper)
        # Too few filled parts for the argument (one text in 10^12): such texts also meet on the parts that both leave empty.
        for k in np.flatnonzero(used & (filled < need)).tolist():
            empty = np.setdiff1d(np.arange(n[k]), part[text == k].astype(np.int64)).astype(U64)
            with np.errstate(over="ignore"):
                keys.append(mix(mix(empty + (U64(scheme[k]) << U64(32)), 13), 15))
            owners.append(np.full(len(empty), doc[k] * 2 + upper))
    return np.concatenate(keys), np.concatenate(owners)


def _send_parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def flush() -> pa.RecordBatch:
        key, owner = map(np.concatenate, zip(*held))
        held.clear()
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        cuts = np.searchsorted(scaled(key, n), np.arange(n + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            s = slice(cuts[p], cuts[p + 1])
            low, far = up(owner[s])
            rows.append((p, np.int64(low).tobytes() + pack(deltas(key[s]), far)))
        return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])

    for batch in batches:
        for step in steps(batch):
            got = _parts(Sets(step.column("text")), ids(step.column("doc")))
            if len(got[0]):
                held.append(got)
                n_held += len(got[0])
            if n_held >= RUN_PARTS:
                yield flush()
                n_held = 0
    if held:
        yield flush()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of texts that agree on a part, each once; large ones as pairs of blocks."""
    keys, owners = [], []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            key, far = unpack(blob[8:])
            keys.append(np.cumsum(key, dtype=U64))
            owners.append(down(int(np.frombuffer(blob, np.int64, 1)[0]), far))
    if not keys:
        return
    key = np.concatenate(keys)
    keys.clear()
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.concatenate([[False], key[1:] == key[:-1], [False]])
    again = same[1:] | same[:-1]
    key, owner = key[again], np.concatenate(owners)[order[again]]
    owners.clear()
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.zeros(0, bool)
    key, owner = key[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    seen: set[bytes] = set()
    out: list[np.ndarray] = []
    n = 0
    for a, b in zip(first.tolist(), [*first[1:].tolist(), len(key)]):
        if b - a < 2 or (owner[a:b] & 1).all():
            continue
        member = owner[a:b] >> 1
        name = member.tobytes()
        if name in seen:
            continue
        seen.add(name)
        blocks = [member[k : k + BLOCK] for k in range(0, len(member), BLOCK)]
        for i in range(len(blocks)):
            for j in range(i + (len(blocks) > 1), len(blocks)):
                out.append(blocks[i] if i == j else np.concatenate([blocks[i], blocks[j]]))
                n += len(out[-1])
        if n > 200_000:
            yield pa.record_batch([pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["docs"])
            out, n = [], 0
    if out:
        yield pa.record_batch([pa.array([x.tolist() for x in out], pa.list_(pa.int64()))], ["docs"])


# ---------------------------------------------------------------- pairs


class Group:
    """Texts that agree on a part, with their sketches brought to one length."""

    def __init__(self, doc: np.ndarray, size: np.ndarray, sketch: list[bytes]):
        self.doc, self.size = doc, size
        least = min(map(len, sketch))
        # Places modulo a smaller power of two fall together, and differing bits stay a lower bound.
        self.bits = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, least // 8), axis=0) for x in sketch])

    def near(self, k: int, others: np.ndarray) -> np.ndarray:
        """Those of others that size and sketch let link with k."""
        a, b = self.size[k], self.size[others]
        apart = np.bitwise_count(self.bits[others] ^ self.bits[k]).sum(axis=1)
        return others[(np.minimum(a, b) * DEN >= np.maximum(a, b) * NUM) & (apart <= _allowed(a + b))]

    def forest(self) -> list[np.ndarray]:
        """Pairs that join all texts which may be linked, directly or by others: fewer than texts."""
        rest, out = np.lexsort((self.doc, self.size)), []
        while len(rest):
            todo, rest = [int(rest[0])], rest[1:]
            while todo and len(rest):
                k = todo.pop()
                near = self.near(k, rest)
                if len(near):
                    out.append(np.stack([np.full(len(near), self.doc[k]), self.doc[near]], axis=1))
                    todo += near.tolist()
                    rest = rest[~np.isin(rest, near)]
        return out

    def across(self, label: np.ndarray) -> list[np.ndarray]:
        """All pairs that may be linked and are not joined yet."""
        out, all_ = [], np.arange(len(self.doc))
        for k in range(len(self.doc) - 1):
            near = self.near(k, all_[k + 1 :][label[k + 1 :] != label[k]])
            if len(near):
                out.append(np.stack([np.full(len(near), self.doc[k]), self.doc[near]], axis=1))
        return out


def _pairs_of(batches: Iterator[pa.RecordBatch], across: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by gid to pairs, group by group."""

    def pairs(gid: np.ndarray, table: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, size, label = (table.column(c).to_numpy() for c in ("doc", "n", "label"))
        sketch, out = table.column("sketch").to_pylist(), []
        cuts = [0, *(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                group = Group(doc[a:b], size[a:b], sketch[a:b])
                out += group.across(label[a:b]) if across else group.forest()
        if out:
            pair = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
            yield pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        gid = batch.column("gid").to_numpy()
        last = int(np.searchsorted(gid, gid[-1]))  # the last group may go on in the next batch
        if last:
            table = pa.Table.from_batches([*held, batch.slice(0, last)])
            yield from pairs(table.column("gid").to_numpy(), table)
            held = []
        held.append(batch.slice(last))
    if held:
        table = pa.Table.from_batches(held)
        yield from pairs(table.column("gid").to_numpy(), table)


def _candidates(rows: DataFrame, across: bool) -> DataFrame:
    """rows: gid, doc, n, sketch, label. Pairs that the sketches let link, smaller number first, each once."""
    rows = rows.select("gid", "doc", "n", "label", "sketch").repartition("gid").sortWithinPartitions("gid")
    return mapped(rows, lambda b: _pairs_of(b, across), "a long, b long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts: whether each is a link."""
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            some = batch.slice(k, 256)
            one, two = Sets(some.column("text_a")), Sets(some.column("text_b"))
            ok = []
            for i in range(some.num_rows):
                both = np.sort(np.concatenate([one.of(i), two.of(i)]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append((common, len(both) - common))
            shared, union = (np.array(x, np.int64) for x in zip(*ok))
            linked = (union > 0) & (DEN * shared >= NUM * union)
            yield pa.record_batch([some.column("a"), some.column("b"), pa.array(shared), pa.array(union), pa.array(linked)], ["a", "b", "shared", "united", "ok"])


def _checked(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """a, b, shared, united, ok for each pair, by the exact sets of its two texts."""
    pairs = stored(pairs, f"parity-{name}-pairs")
    used = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc")))
    texts = SlotFilter(used, "doc").keep(docs, "doc")
    both = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(mapped(both.select("a", "b", "text_a", "text_b"), _verify, "a long, b long, shared long, united long, ok boolean"), f"parity-{name}-links")


# ---------------------------------------------------------------- components


def _two_edges(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """u, v: an edge between each of the pairs of columns, for every row."""
    return rows.select(F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends])).alias("edge")).select("edge.*")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (least node reachable) of every node of edges (a, b), by alternating large and small stars.

    Each round sends every node's neighbours to the least of them; rounds grow with the logarithm of the
    longest path. Hubs with many neighbours are split. Only a count and a checksum come to the driver. Both steps of a round are
    stored, since a plan that repeats them for each use of theirs takes the driver's memory, with a broadcast for each join.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = (now.count(), None)
    while True:
        before = mark
        both = _two_edges(now, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
        large = join_about(both, stored(least, name), ["u"], "degree", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, name)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        now = stored(_two_edges(small, ("v", "m"), ("u", "m")).where("u <> v").distinct(), name)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()


# ---------------------------------------------------------------- the join


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for step in steps(batch):
            sets = Sets(step.column("text"))
            f = [pa.array(sets.sums(mix(sets.key, s)).view(np.int64)) for s in (21, 22)]
            yield pa.record_batch([step.column("doc"), step.column("doc_id"), pa.array(sets.size, pa.int64()), *f, pa.array(sets.sketches(), pa.binary())], ["doc", "doc_id", "n", "f1", "f2", "sketch"])


class Join:
    """The classes of equal sets, the candidates between them, and on demand the links and the groups that they form.

    Rows are known by their number (`keyed`), and a class by that of its first row, since ids may be repeated.
    """

    SAME = ["n", "f1", "f2"]

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark: SparkSession = docs.sparkSession
        self.rows = keyed(docs)
        self.base = self.rows.select(F.col(ROW).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        self.signed = stored(mapped(self.base, _signed, "doc long, doc_id long, n long, f1 long, f2 long, sketch binary"), "parity-signed")
        first = F.min(F.struct("doc_id", "doc"))
        named = self.signed.where("n > 0 and doc_id is not null").groupBy(*self.SAME).agg(first.alias("first"), F.count("*").alias("rows"))
        self.classes = stored(named.select(*self.SAME, "first", "rows", F.col("first.doc").alias("rep")), "parity-classes")
        reps = self.classes.select(F.col("rep").alias("doc"))
        chosen = SlotFilter(reps, "doc").keep(self.base.where("doc_id is not null"), "doc")
        parts = partitions_for(spark, text_bytes(self.base))
        sent = mapped(chosen.select("doc", "text"), lambda b: _send_parts(b, parts), "part int, blob binary").repartitionById(parts, "part")
        self.groups = stored(mapped(sent, _groups, "docs array<long>").distinct().select(F.xxhash64("docs").alias("gid"), "docs"), "parity-groups")
        self.about = self.signed.join(reps, "doc", "left_semi").select("doc", "n", "sketch")
        self.grouped = self.groups.select("gid", F.explode("docs").alias("doc"))

    def links(self) -> DataFrame:
        """a, b, shared, united: every link between two classes, by the numbers of their first rows, with the sizes of the intersection and the union."""
        rows = self.grouped.join(self.about, "doc").withColumn("label", F.col("doc"))
        return _checked(self.base, _candidates(rows, across=True), "all").where("ok").drop("ok")

    def spanning_links(self) -> DataFrame:
        """a, b: links enough to join all that any link joins. Pairs whose texts others have joined by then are not tried."""
        rows = self.grouped.join(self.about, "doc")
        tried = _checked(self.base, _candidates(rows.withColumn("label", F.lit(0)), across=False), "first")
        label = components(tried.where("ok"))
        named = self.grouped.join(label, F.col("doc") == F.col("node"), "left").select("gid", "doc", F.coalesce("component", "doc").alias("label"))
        split = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("gid")
        rest = named.join(split, "gid", "left_semi").join(self.about, "doc")
        again = _candidates(rest, across=True).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        second = _checked(self.base, again, "second")
        return tried.unionByName(second).where("ok").select("a", "b")

    def members(self, links: DataFrame | None = None) -> DataFrame:
        """doc, doc_id, n_shingles, head of every row: head is the least (doc_id, doc) of its group, null for rows that link with nothing."""
        found = components(links if links is not None else self.spanning_links())
        named = self.classes.join(found, F.col("rep") == F.col("node"), "left").select(*self.SAME, "first", "rows", F.coalesce("component", "rep").alias("group"))
        heads = stored(named.groupBy("group").agg(F.min("first").alias("head"), F.count("*").alias("classes")), "parity-heads")
        n = self.classes.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
        about = join_about(named.drop("first"), heads, ["group"], "classes", n[0]).select(*self.SAME, "head", "rows")
        rows = self.signed.select("doc", "doc_id", *self.SAME)
        linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
        joined = join_about(rows.where(linked), stored(about, "parity-about"), self.SAME, "rows", n[1])
        return joined.unionByName(rows.where(~linked).withColumn("head", F.lit(None).cast(joined.schema["head"].dataType))).select("doc", "doc_id", F.col("n").alias("n_shingles"), "head")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each input row.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text's set holds its distinct runs
    of five words, or all its words where they are fewer. Texts link at Jaccard 0.8 or more; component_id is
    the least doc_id reachable by links. Texts that are null or have no words have an empty set and link with nothing. Rows that
    repeat a doc_id get a row each and link each by its own text; a null doc_id links with nothing and has a null component. Other
    columns are ignored; no rows give no rows.
    """
    members = Join(docs, id_col, text_col).members()
    return members.select("doc_id", "n_shingles", F.coalesce("head.doc_id", "doc_id").alias("component_id"))


def linked_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link between different texts, and the texts' documents.

    First: class_a, class_b, shared, united - each pair of different sets at Jaccard 0.8 or more, once, with the sizes of
    intersection and union. Second: doc_id, class_id, n_links - a row for each input row, class_id null where the set is empty or
    doc_id is null, n_links the number of other sets that its own links with. Copies are members of one class, not pairs.
    Rules for words and odd rows are those of ngram_jaccard_join.
    """
    join = Join(docs, id_col, text_col)
    links = join.links()
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep")))
    counted = join.classes.join(ends.groupBy("rep").agg(F.count("*").alias("n_links")), "rep", "left").select(*join.SAME, F.col("rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "rows")
    total = join.classes.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    rows = join.signed.select("doc_id", *join.SAME)
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    members = join_about(rows.where(known), stored(counted, "parity-counted"), join.SAME, "rows", total).select("doc_id", "class_id", "n_links")
    others = rows.where(~known).select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return links.select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "shared", "united"), members.unionByName(others)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group, that of the least doc_id, with all its columns; rows without an id or without words stay."""
    join = Join(docs, id_col, text_col)
    gone = join.members().where("head is not null and head.doc <> doc").select(F.col("doc").alias(ROW))
    return join.rows.join(gone, ROW, "left_anti").select(*docs.columns)
