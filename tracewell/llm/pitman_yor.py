"""A hierarchical Pitman-Yor language model over words, trained and applied by shards of the vocabulary.

Two levels of restaurants: one for each context (the word before, or the end of a document) and their common
parent, whose base is uniform over the known words and one unknown. The customers of a context are its tokens,
the customers of the parent are the tables of its children.

Tokens are dealt by word, so a shard holds all customers of its dishes in all restaurants. Frequent words, a
thousand at most, are not: after a frequent word their counts are one matrix of bounded size, which every slice of
the corpus scores where it is; after any other word they are dealt by that word. Each shard samples the seating of
its dishes by Gibbs moves: a customer drawn at random leaves (closing a table if alone there) and sits down again,
as many in a sweep as the dish has; dishes of many customers move several at once.

Dishes of a restaurant only meet in its totals. Words with one token in NAMED have a number, and their totals as
contexts are a vector that all shards know. All other contexts go by the 64-bit hash of the word: each shard tells
the home of a hash what it holds and is told the total. While it samples, a shard extrapolates the tables of a context
from its own: of numbered contexts by its random share of the vocabulary, of all others by the exact customers.
Probabilities are averaged over the samples with the exact totals of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import crc_text, discarded, slices, stored, strings, whole_text

SHARE = 1000  # words with one token in so many are frequent
NAMED = 60_000  # words with one token in so many have a number as contexts; two bytes hold it
SHARD_TOKENS = 2_000_000  # tokens of a shard
SLICE_CHARS = 6_000_000
BURN_IN, SAMPLES = 12, 4  # sweeps before sampling, sweeps that count
ROUNDS = 64  # of a sweep: a dish of more customers moves an equal part of them in each
STRENGTH = (2.0, 2.0)  # concentration of the parent and of the contexts
TABLE = 256  # seatings of more customers use the limit of the ratio below
OTHER, END = 0, 1  # words without a number; the end of a document, as word and as context


def _pack(a: np.ndarray) -> bytes:
    """An array as one compressed value, first bytes first: the high bytes of small numbers are alike."""
    raw = np.ascontiguousarray(a).reshape(-1).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def _raw(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True) if blob else b""


def _unpack(blob: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(_raw(blob), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 7) for w in words], dtype=np.uint64)


def _words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


# --- counting -----------------------------------------------------------------------------------------------


def _frequent(docs: DataFrame) -> tuple[list[bytes], int, int, int]:
    """The numbered words, frequent ones first, how many are frequent, the training tokens and all tokens.

    A slice reports words with a quarter of the share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, held = strings(batch.column(1)), batch.column(2).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                cut = [_words_of(t) for t in texts[a:b]]
                train = [w for words, h in zip(cut, held[a:b]) if not h for w in words]
                total, ends = sum(map(len, cut)) + b - a, sum(not h for h in held[a:b])
                codes, found = pd.factorize(np.array(train, dtype=object)) if train else (np.empty(0, int), [])
                counts = np.bincount(codes, minlength=len(found))
                hits = np.flatnonzero(counts * 4 * max(SHARE, NAMED) >= len(train) + ends)
                words = [None, None, *[bytes(found[k]) for k in hits]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.binary()), pa.array([0, 1, *[2] * len(hits)], pa.int32()), pa.array([len(train) + ends, total, *counts[hits].tolist()], pa.int64())],
                    ["word", "kind", "times"],
                )

    sums = docs.mapInArrow(run, "word binary, kind int, times long").groupBy("kind", "word").agg(F.sum("times").alias("times"))
    totals = sums.groupBy("kind").agg(F.sum("times").alias("times")).where("kind < 2").collect()
    totals = {r["kind"]: r["times"] for r in totals}
    train = totals.get(0, 0)
    rows = sums.where((F.col("kind") == 2) & (F.col("times") * max(SHARE, NAMED) >= train)).select("word", "times").toArrow()  # NAMED at most
    named = sorted((n * SHARE < train, bytes(w)) for w, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))
    return [w for _, w in named], sum(not rare for rare, _ in named), train, totals.get(1, 0)


def _numbers(named: list[bytes]) -> dict[bytes, int]:
    return {w: k + 2 for k, w in enumerate(named)} | {b"": END}


def _dealt(docs: DataFrame, named: list[bytes], width: int, shards: int) -> DataFrame:
    """Slices as rows. Shard -1: documents and their frequent tokens; other shards: the slice's tokens of that shard.

    Words below ``width`` are frequent. A row of a shard lists its words and how often each is used, then for each
    token the document and the context: a number, or beyond the numbers a place in ``rare``, the hashes of the others.
    In swapped rows the listed words are the contexts, and the numbers are the frequent words that follow.
    """
    names = ["slice", "shard", "swapped", "ids", "held", "words", "uses", "doc", "context", "rare"]
    own, contexts = _numbers(named), len(named) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, held, ids = strings(batch.column(1)), batch.column(2).to_pylist(), batch.column(0).to_pylist()
            for a, b in slices([len(t) for t in texts], SLICE_CHARS):
                tokens, sizes = [], []
                for t in texts[a:b]:
                    words = _words_of(t)
                    tokens += words
                    tokens.append(b"")
                    sizes.append(len(words) + 1)
                codes, found = pd.factorize(np.array(tokens, dtype=object))
                found = [bytes(w) for w in found]
                token_id = np.array([own.get(w, OTHER) for w in found], dtype=np.uint32)[codes]
                before = np.append(-1, codes[:-1])
                context = np.append(np.uint32(END), token_id[:-1])
                doc = np.repeat(np.arange(b - a, dtype=np.uint32), sizes)
                common = (token_id > 0) & (token_id < width)
                flags = np.array([bool(h) for h in held[a:b]], dtype=np.uint8)
                inner = np.where(context < width, context, OTHER).astype(np.uint32)
                cells = _pack(inner[common] * np.uint32(width) + token_id[common])
                rows = [[number], [-1], [False], [ids[a:b]], [_pack(flags)], [None], [_pack(np.array(sizes, np.uint32))], [_pack(doc[common])], [cells], [None]]
                hashes = _hashes(found)
                shard = (hashes % np.uint64(shards)).astype(np.int64)
                for swapped, rest, lead in ((False, np.flatnonzero(~common), codes), (True, np.flatnonzero(common & (inner == OTHER)), before)):
                    rest = rest[np.lexsort((lead[rest], shard[lead[rest]]))]
                    of = shard[lead[rest]]
                    cuts = np.flatnonzero(np.diff(of)) + 1
                    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rest)]) if len(rest) else ():
                        part = rest[lo:hi]
                        code = lead[part]
                        first = np.flatnonzero(np.append(True, np.diff(code) != 0))
                        words = b"\n".join(found[k] for k in code[first].tolist())
                        uses = np.diff(np.append(first, len(code))).astype(np.uint32)
                        rare, other = np.empty(0, np.uint64), (token_id if swapped else context)[part].astype(np.int64)
                        if not swapped:
                            unnamed = np.flatnonzero(other == OTHER)
                            rare, place = np.unique(hashes[before[part[unnamed]]], return_inverse=True)
                            other[unnamed] = contexts + place
                        small = contexts + len(rare) < 65536
                        values = (number, int(of[lo]), swapped, None, _pack(flags), _pack(np.frombuffer(words, np.uint8)), _pack(uses), _pack(doc[part].astype(np.uint32)), _pack(other.astype(np.uint16 if small else np.uint32)), _pack(rare))
                        for column, value in zip(rows, values):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), *[pa.binary()] * 6]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names)
                number += 1

    schema = "slice long, shard int, swapped boolean, ids array<long>, held binary, words binary, uses binary, doc binary, context binary, rare binary"
    return docs.mapInArrow(run, schema)


# --- sampling -----------------------------------------------------------------------------------------------


def alone_ratio(discount: float) -> np.ndarray:
    """Chance that a random one of c customers at t tables sits alone, for c up to TABLE: S(c-1, t-1) / S(c, t)
    with the generalised Stirling numbers of the discount."""
    with np.errstate(divide="ignore", invalid="ignore"):
        out, row = np.zeros((TABLE + 1, TABLE + 1)), np.full(TABLE + 1, -np.inf)
        row[0] = 0.0
        t = np.arange(TABLE + 1)
        for c in range(1, TABLE + 1):
            alone = np.append(-np.inf, row[:-1])
            new = np.logaddexp(alone, np.log(np.maximum(c - 1 - discount * t, 0)) + row)
            out[c] = np.where(np.isfinite(new), np.exp(alone - new), 0)
            row = new
    return out


def _alone(ratio: np.ndarray, discount: float, c: np.ndarray, t: np.ndarray) -> np.ndarray:
    small = (c <= TABLE) & (t <= TABLE)
    return np.where(small, ratio[np.minimum(c, TABLE), np.minimum(t, TABLE)], np.minimum(1.0, discount * (t - 1) / np.maximum(c - 1, 1)))


def discount_of(counts: np.ndarray) -> float:
    """The discount that counts of counts suggest: n1 / (n1 + 2 n2)."""
    ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


def sample_seating(word, context, c, words, contexts, outside, scale, rng, keep=SAMPLES, burn_in=BURN_IN, rounds=ROUNDS, spread=None, extra=None, more=0):
    """Gibbs sampling of tables for the dishes ``(word, context)`` with ``c`` customers, all of which move in a sweep.

    ``outside``: tables in each context, parent's customers and parent's tables of dishes elsewhere that are known;
    ``scale``: what the dishes here stand for among those unknown; ``spread``: the same by context, where it differs.
    ``extra``: of words that other shards hold as well, the parent's customers known elsewhere (others: NaN); their
    customers here are scaled, and the parent's tables for them are not sampled. ``more``: the parent's customers
    elsewhere, by word, of words whose tables in the parent are sampled here. Returns the samples' tables by dish, parent
    customers by word, parent tables by word, and the discounts.
    """
    low = discount_of(c)
    t = np.maximum(1, np.minimum(c, np.round(c.astype(float) ** low))).astype(np.int64)
    each = np.full(contexts, float(scale)) if spread is None else spread
    own = np.ones(words, dtype=bool) if extra is None else np.isnan(extra)
    customers = np.bincount(word, weights=t, minlength=words).astype(np.int64) + more
    high = discount_of(customers[own])
    tables = np.minimum(customers, np.maximum(1, np.round(customers.astype(float) ** high * 0.5)).astype(np.int64)) * own
    ratio_low, ratio_high = alone_ratio(low), alone_ratio(high)
    base = 1.0 / (own.sum() * scale + outside[3] + 1)
    # Dishes by size, so that those with customers left to move are the first ones.
    busy = np.flatnonzero(c >= 2)
    busy = busy[np.argsort(-c[busy], kind="stable")]
    bw, bu, bc = word[busy], context[busy], c[busy].astype(np.int64)
    batch = -(-bc // rounds)
    in_context = outside[0] + each * np.bincount(context, weights=t, minlength=contexts)
    all_customers, all_tables = outside[1] + scale * customers.sum(), outside[2] + scale * tables.sum()
    out = []
    for sweep in range(burn_in + keep):
        for turn in range(rounds):
            fresh = (STRENGTH[0] + high * all_tables) * base
            # Customers of each dish leave and sit down again.
            k = int(np.searchsorted(-bc, -turn))
            if k:
                w, u, n, some = bw[:k], bu[:k], bc[:k], batch[:k]
                old = t[busy[:k]]
                after = old - rng.binomial(some, np.clip(_alone(ratio_low, low, n, old), 0, 1))
                backing = customers[w] - high * tables[w] + fresh
                if extra is not None:
                    backing = np.where(own[w], backing, extra[w] + scale * customers[w])
                new_table = (STRENGTH[1] + low * in_context[u]) * backing / (STRENGTH[0] + all_customers)
                after += rng.binomial(some, np.clip(new_table / (new_table + n - 1 - low * np.maximum(after, 0)), 0, 1))
                change = np.clip(after, 1, n) - old
                moved = np.flatnonzero(change)
                t[busy[moved]] += change[moved]
                in_context += each * np.bincount(u[moved], weights=change[moved], minlength=contexts)
                # The parent's customers come and go with the children's tables.
                at, place = np.unique(w[moved], return_inverse=True)
                net = np.bincount(place, weights=change[moved], minlength=len(at)).astype(np.int64)
                had, held = tables[at], customers[at]
                left = had - rng.binomial(np.maximum(-net, 0), np.clip(_alone(ratio_high, high, held, had), 0, 1))
                held = held + net
                left += rng.binomial(np.maximum(net, 0), np.clip(fresh / (np.maximum(held - high * left, 0) + fresh), 0, 1))
                customers[at], tables[at] = held, np.clip(left, 1, held) * own[at]
                all_customers += scale * net.sum()
                all_tables += scale * (tables[at] - had).sum()
            many = np.flatnonzero((customers > max(turn, 1)) & own)
            if len(many):
                had, held = tables[many], customers[many]
                some = -(-held // rounds)
                left = had - rng.binomial(some, np.clip(_alone(ratio_high, high, held, had), 0, 1))
                left += rng.binomial(some, np.clip(fresh / (fresh + held - 1 - high * np.maximum(left, 0)), 0, 1))
                tables[many] = np.clip(left, 1, held)
                all_tables += scale * (tables[many] - had).sum()
            if not k and not len(many):
                break
        if sweep >= burn_in:
            out.append((t.copy(), customers.copy(), tables.copy()))
    return out, (high, low)


def _rare(rows: pd.DataFrame, own: dict[bytes, int]) -> np.ndarray:
    """The hashes of all contexts without a number in a shard's tokens, in order."""
    parts = [np.empty(0, dtype=np.uint64)]
    for swapped, words, rare in zip(rows["swapped"], rows["words"], rows["rare"]):
        parts.append(_hashes([w for w in _raw(words).split(b"\n") if w not in own]) if swapped else _unpack(rare, np.uint64))
    return np.unique(np.concatenate(parts))


def _tokens(swapped: bool, found: list[bytes], local: np.ndarray, uses: np.ndarray, context: bytes, hashes: bytes, n: int, own: dict[bytes, int], rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and context of a row's ``n`` tokens in the shard's numbering; ``local`` numbers the words of a plain row."""
    size, contexts = int.from_bytes(context[:8], "little"), len(own) + 1
    other = _unpack(context, np.uint16 if size == 2 * n else np.uint32).astype(np.int64)
    if not swapped:
        place = contexts + np.searchsorted(rare, _unpack(hashes, np.uint64))
        return np.repeat(local, uses), np.concatenate([np.arange(contexts), place])[other]
    lead = np.array([own.get(w, OTHER) for w in found], dtype=np.int64)
    unnamed = np.flatnonzero(lead == OTHER)
    lead[unnamed] = contexts + np.searchsorted(rare, _hashes([found[k] for k in unnamed.tolist()]))
    return other, np.repeat(lead, uses)


def _asked(shard: int, shards: int, rare: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    """What a shard holds of the contexts that go by hash, parted by their homes."""
    home = (rare % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cuts = np.flatnonzero(np.diff(home[order])) + 1
    parts = np.split(order, cuts) if len(order) else []
    rows = [(shard, int(home[p[0]]), _pack(rare[p]), _pack(values[:, p].astype(np.uint32))) for p in parts]
    return pd.DataFrame(rows, columns=["shard", "home", "keys", "sums"])


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """The sums of all shards for each hash of a home, told to every shard that named it."""
    keys = [_unpack(k, np.uint64) for k in rows["keys"]]
    values = [_unpack(v, np.uint32).reshape(-1, len(k)) for k, v in zip(keys, rows["sums"])]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(place, weights=v, minlength=len(every)) for v in np.hstack(values)]).astype(np.uint32)
    ends = np.cumsum([len(k) for k in keys])
    told = [_pack(sums[:, place[e - len(k) : e]]) for k, e in zip(keys, ends)]
    return rows[["shard", "home", "keys"]].assign(sums=told)


def _told(rows: pd.DataFrame, lines: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a shard in order and their totals."""
    keys = [np.empty(0, dtype=np.uint64), *[_unpack(k, np.uint64) for k in rows["keys"]]]
    sums = [np.empty((lines, 0), dtype=np.uint32), *[_unpack(v, np.uint32).reshape(lines, -1) for v in rows["sums"]]]
    joined = np.concatenate(keys)
    order = np.argsort(joined)
    return joined[order], np.hstack(sums)[:, order].astype(float)


ASKED = "shard int, home int, keys binary, sums binary"
DISHES = f"{ASKED}, words binary, dish binary, customers binary"


def _gatherer(width: int, shards: int, named: list[bytes]):
    """A shard's words, their dishes (word and context in the shard's numbering, with customers), and what it asks."""
    own = _numbers(named)
    contexts = len(own) + 1

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard, rare = int(rows["shard"].iloc[0]), _rare(rows, own)
        index: dict[bytes, int] = {}
        keys = [np.empty(0, dtype=np.int64)]
        for swapped, held, words, uses, doc, context, hashes in zip(*(rows[c] for c in ("swapped", "held", "words", "uses", "doc", "context", "rare"))):
            uses, doc = _unpack(uses, np.uint32), _unpack(doc, np.uint32)
            trained = _unpack(held, np.uint8)[doc] == 0
            found, local = _raw(words).split(b"\n"), None
            if not swapped:
                start = (np.cumsum(uses) - uses).astype(np.int64)
                trains = np.add.reduceat(trained.astype(np.int64), start) > 0
                local = np.fromiter((width + index.setdefault(w, len(index)) if k else -1 for w, k in zip(found, trains.tolist())), dtype=np.int64, count=len(found))
            word, place = _tokens(swapped, found, local, uses, context, hashes, len(doc), own, rare)
            keys.append((word[trained] << 32) | place[trained])
        dish, c = np.unique(np.concatenate(keys), return_counts=True)
        place = dish & 0xFFFFFFFF
        by_hash = np.flatnonzero(place >= contexts)
        seated = np.bincount(place[by_hash] - contexts, weights=c[by_hash], minlength=len(rare))[None, :]
        head = pd.DataFrame({"shard": [shard], "words": [_pack(np.frombuffer(b"\n".join(index), np.uint8))], "dish": [_pack(np.diff(dish, prepend=0))], "customers": [_pack(c.astype(np.uint32))]})
        out = pd.concat([head, _asked(shard, shards, rare, seated)])[["shard", "home", "keys", "sums", "words", "dish", "customers"]]
        return out.astype({"home": "Int32"}).astype(object).where(out.notna(), None)

    return run


def _trainer(width: int, contexts: int, shards: int, outside: tuple, guess: np.ndarray):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head, shard = rows[rows["home"].isna()].iloc[0], int(rows["shard"].iloc[0])
        rare, told = _told(rows[rows["home"].notna()], 1)
        dish, c = np.cumsum(_unpack(head["dish"], np.int64)), _unpack(head["customers"], np.uint32).astype(np.int64)
        raw = _raw(head["words"])
        words, known, every = width + (raw.count(b"\n") + 1 if raw else 0), np.zeros(len(rare)), contexts + len(rare)
        word, context = dish >> 32, dish & 0xFFFFFFFF
        seated = np.bincount(context, weights=c, minlength=every)
        spread = np.append(np.full(contexts, float(shards)), told[0] / np.maximum(seated[contexts:], 1))
        around = (np.append(outside[0], known), *outside[1:])
        extra = np.append(guess, np.full(words - width, np.nan))
        samples, _ = sample_seating(word, context, c, words, every, around, shards, np.random.default_rng(shard), spread=spread, extra=extra)
        total = sum(s[0] for s in samples)
        by_context = np.stack([np.bincount(context, weights=s[0], minlength=every) for s in samples])
        parent, parent_tables = (np.stack([s[k][width:] for s in samples]).astype(np.uint32) for k in (1, 2))
        shared = np.stack([s[1][:width] for s in samples])
        counts = [words - width, (c == 1).sum(), (c == 2).sum(), (parent[-1] == 1).sum(), (parent[-1] == 2).sum()]
        totals = np.stack([parent.sum(axis=1), parent_tables.sum(axis=1)], axis=1).astype(float)
        main = pd.DataFrame(
            {
                "shard": [shard],
                "words": [head["words"]],
                "dish": [head["dish"]],
                "customers": [head["customers"]],
                "tables": [_pack(total.astype(np.uint32))],
                "parent": [_pack(parent)],
                "parent_tables": [_pack(parent_tables)],
                "in_context": [np.concatenate([seated[:contexts], by_context[:, :contexts].ravel(), shared.ravel()]).tolist()],
                "figures": [[*map(float, counts), *totals.ravel().tolist()]],
            }
        )
        asked = _asked(shard, shards, rare, np.vstack([seated[contexts:], by_context[:, contexts:]]))
        out = pd.concat([main, asked])[["shard", "home", "keys", "sums", *main.columns[1:]]]
        return out.astype({"home": "Int32"}).astype(object).where(out.notna(), None)

    return run


MODEL = f"{DISHES}, tables binary, parent binary, parent_tables binary, in_context array<double>, figures array<double>"


# --- applying -----------------------------------------------------------------------------------------------


def _chances(dish_c, dish_tables, context, parent, parent_tables, g):
    """Averaged probability of dishes; ``parent`` and ``parent_tables`` have a row for each sample."""
    backed = np.zeros(len(context))
    for s in range(SAMPLES):
        fresh = (STRENGTH[0] + g["high"] * g["parent_tables"][s]) * g["base"]
        chance = (parent[s] - g["high"] * parent_tables[s] + fresh) / (STRENGTH[0] + g["parent"][s])
        backed += (STRENGTH[1] + g["low"] * g["tables"][s][context]) / (STRENGTH[1] + g["customers"][context]) * chance
    own = np.maximum(dish_c - g["low"] * dish_tables / SAMPLES, 0) / (STRENGTH[1] + g["customers"][context])
    return own + backed / SAMPLES


def _applier(g: dict, width: int, named: list[bytes]):
    own = _numbers(named)

    def run(_key, tokens: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = []
        m = model[model["home"].isna()].iloc[0]
        rare, told = _told(model[model["home"].notna()], SAMPLES + 1)
        raw = _raw(m["words"])
        index = {w: width + k for k, w in enumerate(raw.split(b"\n"))} if raw else {}
        unknown = width + len(index)
        keys = np.append(np.cumsum(_unpack(m["dish"], np.int64)), np.iinfo(np.int64).max)
        c, tables = (np.append(_unpack(m[n], np.uint32).astype(float), 0) for n in ("customers", "tables"))
        count = np.bincount(keys[:-1] >> 32, weights=c[:-1], minlength=unknown + 1)
        parent, parent_tables = (np.hstack([g[f"{n}_frequent"], _unpack(m[n], np.uint32).reshape(SAMPLES, -1), np.zeros((SAMPLES, 1))]) for n in ("parent", "parent_tables"))
        here = g | {"customers": np.append(g["customers"], told[0]), "tables": [np.append(a, b) for a, b in zip(g["tables"], told[1:])]}
        for number, swapped, held, words, uses, doc, context, hashes in zip(*(tokens[n] for n in ("slice", "swapped", "held", "words", "uses", "doc", "context", "rare"))):
            uses, doc, docs = _unpack(uses, np.uint32), _unpack(doc, np.uint32), len(_unpack(held, np.uint8))
            found, local = _raw(words).split(b"\n"), None
            if not swapped:
                local = np.fromiter((index.get(w, unknown) for w in found), dtype=np.int64, count=len(uses))
            word, place = _tokens(swapped, found, local, uses, context, hashes, len(doc), own, rare)
            pair, back = np.unique((word << 32) | place, return_inverse=True)
            at = np.searchsorted(keys, pair)
            hit = keys[at] == pair
            pw = pair >> 32
            chance = _chances(np.where(hit, c[at], 0), np.where(hit, tables[at], 0), pair & 0xFFFFFFFF, parent[:, pw], parent_tables[:, pw], here)
            sums = [np.bincount(doc, weights=np.log10(chance)[back], minlength=docs)]
            if swapped:  # the base of frequent words is counted where they are
                sums += [np.zeros(docs), np.zeros(docs, dtype=np.uint32)]
            else:
                sums += [
                    np.bincount(doc, weights=np.log10((count[word] + 0.5) / g["base_total"]), minlength=docs),
                    np.bincount(doc, weights=count[word] > 0, minlength=docs).astype(np.uint32),
                ]
            there = np.flatnonzero(np.bincount(doc, minlength=docs)).astype(np.uint32)
            out.append((number, _pack(there), *[_pack(x[there]) for x in sums]))
        return pd.DataFrame(out, columns=["slice", "doc", "score", "base", "known"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """Train on all whole texts but the held-out fold and score every text.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity``, one row for each row.
    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and an end closes each text. ``base_score`` adds
    half a count to every word; ``score`` is the model's log10 probability. A null text is empty (its end is its
    only token); a row with a null id is never held out. With no training tokens every word is unknown. An empty
    table gives an empty one; further columns are ignored.
    """
    fold = F.coalesce(F.pmod(crc_text(id_col), F.lit(folds)) == held_out, F.lit(False))
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), whole_text(text_col).alias("text"), fold.alias("held"))
    named, frequent, train, total = _frequent(source)
    width, contexts = frequent + 2, len(named) + 2
    shards = max(1, -(-total // SHARD_TOKENS))
    dealt = stored(_dealt(source, named, width, shards), "tokens")
    # The frequent words' matrix: at most (SHARE + 2) squared cells. Those after other words lie in the shards.
    cells = dealt.where("shard = -1").mapInArrow(_cells, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).toArrow()
    cell, times = cells.column(0).to_numpy().astype(np.int64), cells.column(1).to_numpy().astype(np.int64)
    order = np.argsort(cell)
    cell, times = cell[order], times[order]
    present = np.bincount(cell % width, weights=times, minlength=width)
    cell, times = cell[cell // width != OTHER], times[cell // width != OTHER]
    fw, fu = cell % width, cell // width
    tables = np.maximum(1, times.astype(float) ** discount_of(times))
    known_frequent = int((present > 0).sum())
    outside = (np.bincount(fu, weights=tables, minlength=contexts), tables.sum(), 0.5 * known_frequent, known_frequent)
    gathered = stored(dealt.where("shard >= 0").groupBy("shard").applyInPandas(_gatherer(width, shards, named), DISHES), "dishes")
    trainer = _trainer(width, contexts, shards, outside, np.bincount(fw, weights=tables, minlength=width))
    model = stored(_answered(gathered).groupBy("shard").applyInPandas(trainer, MODEL), "model")
    discarded(gathered)
    g = _globals(model, width, contexts, fw, fu, times, present, train)
    spread = docs.sparkSession.sparkContext.broadcast(g)  # a few matrices over the frequent words and vectors over the contexts
    parts = dealt.where("shard >= 0").groupBy("shard").cogroup(_answered(model.drop("in_context", "figures")).groupBy("shard")).applyInPandas(
        lambda key, a, b: _applier(spread.value, width, named)(key, a, b), "slice long, doc binary, score binary, base binary, known binary"
    )
    common = dealt.where("shard = -1").mapInArrow(_common(spread, width), "slice long, doc binary, score binary, base binary, known binary, ids array<long>, held binary, uses binary")
    parts = parts.selectExpr("*", "CAST(NULL AS array<long>) AS ids", "CAST(NULL AS binary) AS held", "CAST(NULL AS binary) AS uses")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    summed = common.unionByName(parts).groupBy("slice").applyInPandas(_summed, schema)
    perplexity = F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score", perplexity.alias("perplexity"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for held, doc, cell in zip(*(batch.column(n).to_pylist() for n in ("held", "doc", "context"))):
            trained = _unpack(held, np.uint8)[_unpack(doc, np.uint32)] == 0
            found, times = np.unique(_unpack(cell, np.uint32)[trained], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(times.astype(np.int64))], ["cell", "times"])


def _answered(rows: DataFrame) -> DataFrame:
    """The shards' own rows, and in place of what they asked the totals they are told."""
    told = rows.where("home IS NOT NULL").select("shard", "home", "keys", "sums").groupBy("home").applyInPandas(_totals, ASKED)
    return rows.where("home IS NULL").unionByName(told, allowMissingColumns=True)


def _summed_up(model: DataFrame, column: str, length: int) -> np.ndarray:
    sums = model.select(F.posexplode(column)).groupBy("pos").agg(F.sum("col").alias("x")).toArrow()
    out = np.zeros(length)
    out[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    return out


def _globals(model: DataFrame, width: int, contexts: int, fw, fu, times, present, train: int) -> dict:
    """Totals of all shards and the sampled matrix of the frequent words."""
    flat = _summed_up(model, "in_context", (SAMPLES + 1) * contexts + SAMPLES * width)  # NAMED and SHARE bound it
    numbers = _summed_up(model, "figures", 5 + 2 * SAMPLES)
    flat, shared, totals = flat[: (SAMPLES + 1) * contexts].reshape(SAMPLES + 1, contexts), flat[(SAMPLES + 1) * contexts :].reshape(SAMPLES, width), numbers[5:].reshape(SAMPLES, 2)
    vocabulary = int(numbers[0]) + int((present > 0).sum())
    ones, twos = numbers[1] + (times == 1).sum(), numbers[2] + (times == 2).sum()
    low = float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))
    high = float(np.clip(numbers[3] / (numbers[3] + 2 * numbers[4]) if numbers[3] else 0.5, 0.05, 0.95))
    outside = (flat[1:, :width].mean(axis=0), totals[:, 0].mean(), totals[:, 1].mean(), numbers[0])
    more = np.round(shared.mean(axis=0)).astype(np.int64)
    samples = sample_seating(fw, fu, times, width, width, outside, 1.0, np.random.default_rng(1), more=more)[0]
    parent = np.stack([s[1] - more + mine for s, mine in zip(samples, shared)]) * (present > 0)
    parent_tables = np.minimum(np.stack([s[2] for s in samples]), parent)
    g = {
        "low": low,
        "high": high,
        "base": 1.0 / (vocabulary + 1),
        "base_total": train + 0.5 * (vocabulary + 1),
        "customers": flat[0] + np.bincount(fu, weights=times, minlength=contexts),
        "tables": [flat[s + 1] + np.bincount(fu, weights=samples[s][0], minlength=contexts) for s in range(SAMPLES)],
        "parent": [totals[s, 0] + parent[s].sum() for s in range(SAMPLES)],
        "parent_tables": [totals[s, 1] + parent_tables[s].sum() for s in range(SAMPLES)],
        "parent_frequent": parent,
        "parent_tables_frequent": parent_tables,
    }
    grid = np.arange(width * width)
    c, tables = np.zeros(len(grid)), np.zeros(len(grid))
    c[fu * width + fw] = times
    tables[fu * width + fw] = sum(s[0] for s in samples)
    w = grid % width
    g["log_cell"] = np.log10(_chances(c, tables, grid // width, parent[:, w], parent_tables[:, w], g))
    g["log_cell"][grid // width == OTHER] = 0.0  # scored in the shard of the word before
    g["log_base"] = np.log10((present + 0.5) / g["base_total"])
    g["present"] = present > 0
    return g


def _common(spread, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = spread.value
        for batch in batches:
            for number, ids, held, uses, doc, cell in zip(*(batch.column(n).to_pylist() for n in ("slice", "ids", "held", "uses", "doc", "context"))):
                doc, cell = _unpack(doc, np.uint32), _unpack(cell, np.uint32)
                word, n = cell % width, len(ids)
                score = np.bincount(doc, weights=g["log_cell"][cell], minlength=n)
                base = np.bincount(doc, weights=g["log_base"][word], minlength=n)
                known = np.bincount(doc, weights=g["present"][word], minlength=n).astype(np.uint32)
                blobs = [_pack(np.arange(n, dtype=np.uint32)), _pack(score), _pack(base), _pack(known)]
                columns = [pa.array([number]), *[pa.array([x], pa.binary()) for x in blobs], pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.binary()), pa.array([uses], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "doc", "score", "base", "known", "ids", "held", "uses"])

    return run


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    head = rows[rows["held"].notna()].iloc[0]
    sizes = _unpack(head["uses"], np.uint32)
    score, base, known = np.zeros(len(sizes)), np.zeros(len(sizes)), np.zeros(len(sizes), dtype=np.int64)
    for doc, s, b, k in zip(rows["doc"], rows["score"], rows["base"], rows["known"]):
        at = _unpack(doc, np.uint32)
        score[at] += _unpack(s, np.float64)
        base[at] += _unpack(b, np.float64)
        known[at] += _unpack(k, np.uint32)
    ids = pd.array([None if x is None or x != x else int(x) for x in head["ids"]], dtype="Int64")
    return pd.DataFrame({"doc_id": ids, "held_out": _unpack(head["held"], np.uint8) == 1, "n_tokens": sizes.astype(np.int64), "n_known": known, "base_score": base, "score": score})
