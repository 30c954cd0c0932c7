"""Documents scored by cross-entropy difference: loss per word under a target model less that under a background model.

Both are bigram models, smoothed towards their own word frequencies, over one shared vocabulary: all words that occur at
least MIN_COUNT times in the corpus, whatever its size, all others being one unknown word. They are matched: same vocabulary, same
word pairs (all that occur MIN_COUNT times), same smoothing:

    P(w | a) = (c(a, w) + smoothing * p(w)) / (C(a) + smoothing),    p(w) = (c(w) + 1/2) / (N + (V + 1) / 2)

c(a, w) is 0 for pairs that are not known and C(a) counts all places at which a word follows a, so the part of pairs seen once is
held back for what is not seen, as Good and Turing do. The background is counted over all documents, the target over all target documents.

A text's loss is a sum of terms of a word (its own loss, and that of falling back after it) and of a pair (-log(1 + c / (smoothing * p(w)))).

1. Words are counted, combined in each task and then by a shuffle. Those of a share of `word_share` or more, 1 / word_share
   at most, are broadcast; so are pairs of such words that are frequent in some task's texts, 4 / pair_share at most, once
   counted over all texts. Their terms are added where the text is read.
2. All other words and pairs meet in buckets, in one shuffle: a pair that ends in a frequent word by its hash, any other word with the pairs that end
   in it by the word's hash. So a bucket has all occurrences of what it holds, counts it, and knows the terms. A bucket's part of about
   a million words of text is one packed row, and so is what it sends back for them: sums for each text.

Which way an entry takes changes no result but for rounding. No key that goes to a bucket is frequent, so no bucket is large. Nothing
is left out: the tables grow with the corpus, and only the two broadcast ones are bounded.

Target documents are told apart by a Bloom table of bounded size; only those that it holds back are shuffled to meet the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import scratch, sifted, slices, small_batches

#: Occurrences in the corpus from which words and pairs are in the models.
MIN_COUNT = 2
#: Shares of the corpus from which words and pairs are broadcast.
WORD_SHARE, PAIR_SHARE = 1e-5, 1e-5
#: Stands before the first word of a text.
BEGIN = 0x1B873593CC9E2D51
#: Pseudo-counts of the word frequencies in a pair's probability.
SMOOTHING = 100.0
#: Texts and words that are packed together.
DOCS, WORDS = 4096, 1 << 20
#: Buckets for each shuffle partition.
BUCKETS = 4
#: Flags of a text: it is counted in the background, in the target.
BACKGROUND, TARGET = 1, 2


def _pair(before, word):
    """A hash of two words in order."""
    import numpy as np

    from lodestone.llm.shingles import _mix

    return _mix((before << np.uint64(1) | before >> np.uint64(63)) ^ word)


def _runs(batches):
    """Parts of about WORDS words and at most DOCS texts: (ids as Arrow arrays, flags, words of each text, all words, the word
    before each, whether one follows, its text's number)."""
    import numpy as np
    import pyarrow as pa

    from lodestone.llm import shingles

    ids, flags, sizes, words, held, docs = [], [], [], [], 0, 0

    def part():
        size, w = np.concatenate(sizes), np.concatenate(words)
        ends = np.cumsum(size)
        full = size > 0
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[(ends - size)[full]] = BEGIN
        inner = np.ones(len(w), dtype=bool)
        inner[ends[full] - 1] = False
        return pa.chunked_array(ids).combine_chunks(), np.concatenate(flags), size, w, before, inner, np.repeat(np.arange(len(size)), size)

    for batch in batches:
        mark = np.asarray(batch.column(batch.schema.get_field_index("flags")), dtype=np.uint8)
        for at, n, data, ends in slices(batch, "text"):
            all_words, begin = shingles.word_hashes(data, ends)
            for lo in range(0, n, DOCS):
                hi = min(n, lo + DOCS)
                if docs and (docs + hi - lo > DOCS or held + begin[hi] - begin[lo] > WORDS):
                    yield part()
                    ids, flags, sizes, words, held, docs = [], [], [], [], 0, 0
                ids.append(batch.column(0).slice(at + lo, hi - lo))
                flags.append(mark[at + lo : at + hi])
                sizes.append(np.diff(begin[lo : hi + 1]))
                words.append(all_words[begin[lo] : begin[hi]])
                held, docs = held + int(begin[hi] - begin[lo]), docs + hi - lo
    if docs:
        yield part()


def _counted(keys, *weights) -> list:
    """The distinct keys, and for each of the weights its sum by key."""
    import numpy as np

    if not len(keys):
        return [keys, *(np.zeros(0, dtype=np.int64) for _ in weights)]
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[first], *(np.add.reduceat(w[order].astype(np.int64), first) for w in weights)]


def _count_words(share: float):
    """Of each part: its words with n and t (occurrences in background and target texts) and those before another word (fn, ft);
    pairs that are frequent in the part, with n."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names = ["pair", "h", "n", "t", "fn", "ft"]
        for _, flags, _, w, before, inner, doc in _runs(batches):
            b, t = flags[doc] & BACKGROUND, flags[doc] // TARGET
            h, n, tn, fn, ft = _counted(w, b, t, b * inner, t * inner)
            columns = [pa.array(x.astype(np.int64)) for x in (n, tn, fn, ft)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), dtype=bool)), pa.array(h.view(np.int64)), *columns], names=names)
            h, n = _counted(_pair(before, w), b)
            often = n >= max(4, share * len(w) / 4)
            h, n = h[often], pa.array(n[often])
            zero = pa.array(np.zeros(len(h), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), dtype=bool)), pa.array(h.view(np.int64)), n, zero, zero, zero], names=names)

    return run


def _find(sorted_keys, keys):
    """(place of each key, whether it is among the sorted ones)."""
    import numpy as np

    if not len(sorted_keys):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys


def _count_pairs(shared):
    """Of each task: the counts (n, t) of the pairs that are among the candidates and end in a frequent word."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        vocab, keys = shared.value
        n, t = (np.zeros(len(keys), dtype=np.int64) for _ in range(2))
        for _, flags, _, w, before, _, doc in _runs(batches):
            _, known = _find(vocab, w)
            at, hit = _find(keys, _pair(before, w))
            hit &= known
            n += np.bincount(at[hit], weights=flags[doc[hit]] & BACKGROUND, minlength=len(keys)).astype(np.int64)
            t += np.bincount(at[hit], weights=flags[doc[hit]] // TARGET, minlength=len(keys)).astype(np.int64)
        some = np.flatnonzero(n + t)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some]), pa.array(t[some])], names=["h", "n", "t"])

    return run


def _planes(x):
    """The bytes of an array, those of one weight together, which compresses well."""
    import numpy as np

    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


class _Reader:
    """Reads what _planes() has written."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int, kind):
        import numpy as np

        width = np.dtype(kind).itemsize
        raw = np.frombuffer(self.data, dtype=np.uint8, count=n * width, offset=self.at)
        self.at += n * width
        return np.ascontiguousarray(raw.reshape(width, n).T).view(kind).ravel()


#: Bits of a packed key that tell the words before one word apart.
_LOW = 40
_ROW = "bucket int, kind int, chunk long, data binary, idx int, n_words long, t double, b double, doc_id "


def _packed(bucket, key, doc, inner):
    """Rows alike in bucket, key and doc (which ascends) as one: (bucket, key, doc, occurrences, those before another word)."""
    import numpy as np

    order = np.argsort(key, kind="stable")
    order = order[np.argsort(bucket[order], kind="stable")]
    bucket, key, doc = bucket[order], key[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])]))
    count = np.diff(np.append(first, len(key))).astype(np.uint32)
    return bucket[first], key[first], doc[first], count, np.add.reduceat(inner[order].astype(np.int64), first).astype(np.uint32)


def _ask(shared, buckets: int, kind: str):
    """For each text a row with the sums of the broadcast terms (kind 0); for each part and bucket a packed row of the pairs that end
    in a frequent word (kind 1), and one of the other words with the pairs that end in them (kind 2)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from lodestone.llm.shingles import _mix

        m = shared.value
        names = [c.split()[0] for c in (_ROW + kind).split(", ")]
        number = TaskContext.get().partitionId() << 32

        def packs(kind_, rows):
            if rows:
                b, c, d = zip(*rows, strict=True)
                k = len(rows)
                empty = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, id_type)]
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array([kind_] * k, pa.int32()), pa.array(c, pa.int64()), pa.array(d, pa.binary()), *empty], names=names)

        for ids, flags, size, w, before, inner, doc in _runs(batches):
            number += 1
            id_type, n = ids.type, len(size)
            place, known = _find(m["vocab"], w)
            pair = _pair(before, w)
            hot_at, hot = _find(m["pairs"], pair)
            hot &= known
            sums = {}
            for k in "tb":
                loss = np.full(len(w), m["unknown_" + k])
                loss[known] = m["word_" + k][place[known]] + m["after_" + k][place[known]] * inner[known]
                loss[hot] -= np.log1p(m["pair_" + k][hot_at[hot]] / (m["smoothing"] * m["p_" + k][place[hot]]))
                sums[k] = np.bincount(doc, weights=loss, minlength=n) + m["begin_" + k] * (size > 0)
            none = pa.nulls(n, pa.binary())
            home = np.full(n, number % buckets, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, number)), none, pa.array(np.arange(n, dtype=np.int32)), pa.array(size.astype(np.int64)), pa.array(sums["t"]), pa.array(sums["b"]), ids], names=names)

            label = (doc | flags[doc].astype(np.int64) << 12).astype(np.uint16)
            low = np.uint64((1 << _LOW) - 1)
            at = np.flatnonzero(known & ~hot)
            if len(at):
                key = (place[at].astype(np.uint64) << np.uint64(_LOW)) | (pair[at] & low)
                bucket = (_mix(pair[at]) % np.uint64(buckets)).astype(np.int32)
                b, key, d, c, _ = _packed(bucket, key, label[at], inner[at])
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
                rows = [(int(b[lo]), number, _planes(key[lo:hi]) + _planes(d[lo:hi]) + _planes(c[lo:hi])) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
                yield from packs(1, rows)
            at = np.flatnonzero(~known)
            if len(at):
                rare, own = np.unique(w[at], return_inverse=True)
                of = (_mix(rare) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(of, kind="stable")
                rank = np.empty(len(rare), dtype=np.int64)
                rank[order] = np.arange(len(rare))
                begin = np.searchsorted(of[order], np.arange(buckets + 1))
                rare = rare[order]
                key = ((rank - begin[of])[own].astype(np.uint64) << np.uint64(_LOW)) | (pair[at] & low)
                b, key, d, c, i = _packed(of[own], key, label[at], inner[at])
                cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
                rows = []
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    mine = rare[begin[b[lo]] : begin[b[lo] + 1]]
                    head = len(mine).to_bytes(8, "little")
                    rows.append((int(b[lo]), number, head + _planes(mine) + _planes(key[lo:hi]) + _planes(d[lo:hi]) + _planes(c[lo:hi]) + _planes(i[lo:hi])))
                yield from packs(2, rows)

    return run


def _solve(shared, kind: str):
    """Rows sorted by bucket: rows of texts as they are, and for each packed row one with what is added to the sums of its texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        m = shared.value
        names = [c.split()[0] for c in (_ROW + kind).split(", ")]
        smoothing = m["smoothing"]

        def answers(held):
            parts = []  # (number of the packed row, key, label, occurrences, before another word)
            words, offset = [], 0
            for k, (what, _, data) in enumerate(held):
                r = _Reader(data)
                if what == 1:
                    n = len(data) // 14
                    key, d, c = r.take(n, np.uint64), r.take(n, np.uint16), r.take(n, np.uint32)
                    parts.append((np.full(n, k), key >> np.uint64(_LOW), key, d, c, np.zeros(n, np.uint32)))
                else:
                    size = int.from_bytes(data[:8], "little")
                    r.at = 8
                    own = r.take(size, np.uint64)
                    n = (len(data) - r.at) // 18
                    key, d, c, i = r.take(n, np.uint64), r.take(n, np.uint16), r.take(n, np.uint32), r.take(n, np.uint32)
                    words.append(own)
                    parts.append((np.full(n, k), (key >> np.uint64(_LOW)) + np.uint64(len(m["vocab"]) + offset), key, d, c, i))
                    offset += size
            row, word, key, label, c, inner = (np.concatenate(x) for x in zip(*parts, strict=True))
            word = word.astype(np.int64)
            base = len(m["vocab"])
            rare, to = np.unique(np.concatenate(words), return_inverse=True) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            late = word >= base
            word[late] = base + to[word[late] - base]
            b, t = (label >> np.uint16(12)) & BACKGROUND, label >> np.uint16(13)
            doc = (label & np.uint16(0xFFF)).astype(np.int64)
            c = c.astype(np.int64)

            each = lambda x: np.bincount(word[late] - base, weights=x[late], minlength=len(rare))
            seen = {"b": each(c * b), "t": each(c * t)}
            follow = {"b": each(inner * b), "t": each(inner * t)}
            known = seen["b"] >= MIN_COUNT
            pair = (key & np.uint64((1 << _LOW) - 1)) | (word.astype(np.uint64) << np.uint64(_LOW))
            order = np.argsort(pair, kind="stable")
            group = np.empty(len(pair), dtype=np.int64)
            group[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
            total = {"b": np.bincount(group, weights=c * b), "t": np.bincount(group, weights=c * t)}
            both = (total["b"] >= MIN_COUNT)[group] & (~late | np.concatenate([np.zeros(base, bool), known])[word])
            add = {}
            for k in "tb":
                p = np.concatenate([m["p_" + k], (seen[k] + 0.5) / m["mass_" + k]])
                x = np.zeros(len(c))
                w = word[late] - base
                own = np.where(known, -np.log(p[base:]) - m["unknown_" + k], 0.0)
                after = np.where(known, np.log1p(follow[k] / smoothing), 0.0)
                x[late] = c[late] * own[w] + inner[late] * after[w]
                x[both] -= c[both] * np.log1p(total[k][group[both]] / (smoothing * p[word[both]]))
                add[k] = x
            some = np.flatnonzero((add["t"] != 0) | (add["b"] != 0))
            at = row[some] * DOCS + doc[some]
            at, place = np.unique(at, return_inverse=True)
            t, b = (np.bincount(place, weights=add[k][some], minlength=len(at)).astype(np.float32) for k in "tb")
            cut = np.searchsorted(at, np.arange(len(held) + 1) * DOCS)
            for k, (_, chunk, _) in enumerate(held):
                lo, hi = cut[k], cut[k + 1]
                if hi > lo:
                    yield chunk, _planes((at[lo:hi] % DOCS).astype(np.uint16)) + _planes(t[lo:hi]) + _planes(b[lo:hi])

        def out(rows):
            k = len(rows)
            chunk, data = zip(*rows, strict=True)
            empty = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.nulls(k, id_type)]
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.array([1] * k, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary()), *empty], names=names)

        now, held = None, []
        for batch in batches:
            id_type = batch.schema.field(batch.num_columns - 1).type
            what = np.asarray(batch.column(1))
            if (what == 0).any():
                yield batch.filter(pa.array(what == 0))
            some = np.flatnonzero(what)
            if not len(some):
                continue
            packed = batch.take(pa.array(some))
            for bucket, what, chunk, data in zip(*(packed.column(c).to_pylist() for c in range(4)), strict=True):
                if bucket != now:
                    if held and (rows := list(answers(held))):
                        yield out(rows)
                    now, held = bucket, []
                held.append((what, chunk, data))
        if held and (rows := list(answers(held))):
            yield out(rows)

    return run


def _total(kind: str):
    """Rows sorted by part, those of texts first: for each text its id, words and sums with all that is added to them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, texts, t, b = None, [], None, None

        def done():
            rows = pa.Table.from_batches(texts)
            order = np.asarray(rows.column("idx").combine_chunks(), dtype=np.int64)
            base = [np.asarray(rows.column(c).combine_chunks()) for c in "tb"]
            out = [rows.column("doc_id").combine_chunks(), rows.column("n_words").combine_chunks(), pa.array(base[0] + t[order]), pa.array(base[1] + b[order])]
            return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=["doc_id", "n_words", "t", "b"])

        for batch in batches:
            chunks = np.asarray(batch.column(2))
            cut = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                if chunks[lo] != now:
                    if texts:
                        yield done()
                    now, texts, t, b = chunks[lo], [], np.zeros(DOCS), np.zeros(DOCS)
                own = batch.slice(lo, hi - lo)
                what = np.asarray(own.column(1))
                texts.append(own.filter(pa.array(what == 0)))
                for data in own.column(3).filter(pa.array(what != 0)).to_pylist():
                    n = len(data) // 10
                    r = _Reader(data)
                    at = r.take(n, np.uint16).astype(np.int64)
                    t[at] += r.take(n, np.float32)
                    b[at] += r.take(n, np.float32)
        if texts:
            yield done()

    return run


def _arrays(df: DataFrame):
    """A bounded table as arrays, its first column as unsigned numbers by which it is sorted."""
    import numpy as np

    data = df.toArrow()
    columns = [data[k].to_numpy().astype(np.int64) for k in range(data.num_columns)]
    order = np.argsort(columns[0].view(np.uint64))
    return [columns[0].view(np.uint64)[order], *(x[order].astype(np.float64) for x in columns[1:])]


def _flagged(docs: DataFrame, target: DataFrame, id_col: str, text_col: str, others: DataFrame | None) -> DataFrame:
    """doc_id, text, flags of docs and of others, which are in neither model."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sure, maybe, ids, same = sifted(rows, "doc_id", target.select(F.col(id_col)), 1 << 18)
    flag = F.when(F.col("__id").isNull(), BACKGROUND).otherwise(BACKGROUND + TARGET)
    met = scratch(maybe.join(ids.hint("merge"), same, "left").select("doc_id", "text", flag.cast("byte").alias("flags")), "flagged")
    out = sure.select("doc_id", "text", F.lit(BACKGROUND).cast("byte").alias("flags")).union(met)
    if others is not None:
        out = out.union(others.select(F.col(id_col).cast(rows.schema["doc_id"].dataType), F.col(text_col), F.lit(0).cast("byte")))
    return out


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: DataFrame | None = None, word_share: float = WORD_SHARE, pair_share: float = PAIR_SHARE, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a word), score (their difference: lower is nearer the target).

    docs: the background; target: the ids (in a column named as id_col) of the target documents; others: more texts to score that
    are in neither model. A row for each row of docs and others. Null, empty and blank texts have no words, and losses and a score
    of 0. A null id is never in the target; repeated target ids count once, repeated documents each time. Other columns are not
    looked at. A very long text is a part of its own. An empty table gives no rows. The tables are read several times and in the
    same order each time, as files are; write other ones first."""
    import numpy as np

    spark = docs.sparkSession
    rows = small_batches(_flagged(docs, target, id_col, text_col, others))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = rows.mapInArrow(_count_words(pair_share), "pair boolean, h long, n long, t long, fn long, ft long").groupBy("pair", "h")
    counts = scratch(counts.agg(*(F.sum(c).alias(c) for c in ("n", "t", "fn", "ft"))), "counts")
    words = counts.where("not pair")
    known = F.col("n") >= MIN_COUNT
    one = lambda c: F.sum(F.when(known, F.col(c)).otherwise(0))
    total = words.agg(F.sum("n"), F.sum("t"), one("n"), one("t"), F.count(F.when(known, 1)), F.sum("fn"), F.sum("ft")).first()
    n, t, known_n, known_t, size, fn, ft = (x or 0 for x in total)

    often = words.where(F.col("n") >= max(float(MIN_COUNT), n * word_share))
    vocab, *seen = _arrays(often.select("h", "n", "t", "fn", "ft"))  # 1 / word_share rows at most
    asked, _ = _arrays(counts.where("pair").where(F.col("n") >= max(4.0, n * pair_share / 4)).select("h", "n"))  # 4 / pair_share rows at most
    sent = spark.sparkContext.broadcast((vocab, asked))
    exact = rows.mapInArrow(_count_pairs(sent), "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    pairs, *pair_seen = _arrays(exact) if len(asked) else (asked, asked.astype(float), asked.astype(float))

    m = {"vocab": vocab, "pairs": pairs, "smoothing": smoothing}
    for k, (name, all_, of_known, begins) in enumerate((("b", n, known_n, n - fn), ("t", t, known_t, t - ft))):
        m["mass_" + name] = float(all_) + 0.5 * (size + 1)
        m["unknown_" + name] = -float(np.log((all_ - of_known + 0.5) / m["mass_" + name]))
        m["p_" + name] = (seen[k] + 0.5) / m["mass_" + name]
        m["word_" + name] = -np.log(m["p_" + name])
        m["after_" + name] = np.log1p(seen[k + 2] / smoothing)
        m["begin_" + name] = float(np.log1p(begins / smoothing))  # a text that has words begins once and ends once
        m["pair_" + name] = pair_seen[k] * (pair_seen[0] >= MIN_COUNT)
    shared = spark.sparkContext.broadcast(m)
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asks = rows.mapInArrow(_ask(shared, buckets, kind), _ROW + kind)
    met = asks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_solve(shared, kind), _ROW + kind)
    sums = met.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_total(kind), f"doc_id {kind}, n_words long, t double, b double")
    mean = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return sums.select("doc_id", "n_words", mean("t").alias("target_loss"), mean("b").alias("background_loss"), (mean("t") - mean("b")).alias("score"))
