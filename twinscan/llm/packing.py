"""Filling fixed-capacity containers with documents by lexical retrieval.

Method: the documents are range-partitioned into shards of bounded size, neighbours in the given locality
together. Each shard builds a BM25 inverted index; the largest unused document seeds a container, the index
returns its unused neighbours by score, and those that fit fill the window. What space is left goes to the
largest unused documents of the shard that fit, so almost none stays unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.shingles import token_hashes
from twinscan.llm.tokens import VOCABULARY, token_count
from twinscan.plans.scratch import cut

SHARD = 4000  # documents of one index
PER_DOCUMENT = 100  # what a document costs besides its words, in postings
SIZED = "id long, place array<string>, n_tokens long, length int, terms binary, counts binary"
PACKED = "limit_name string, capacity long, container_id string, doc_id long, part int, start_token long, n_tokens long, how string"


def _sized(batches: Iterator[pd.DataFrame], vocabulary: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            words, offsets = token_hashes([t.lower() for t in part["t"]], words_only=True)
            for i, (rid, place, text) in enumerate(zip(part["id"], part["place"], part["t"])):
                terms, counts = np.unique((words[offsets[i] : offsets[i + 1]] >> np.uint64(32)).astype(np.uint32), return_counts=True)
                rows.append((rid, place, token_count(text, vocabulary), int(counts.sum()), terms.tobytes(), counts.astype(np.uint32).tobytes()))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SIZED.split(", ")])


class Index:
    """BM25 inverted index over the documents of one shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, k1: float = 1.2, b: float = 0.75):
        self.n = len(terms)
        doc = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t in terms])
        term = np.concatenate(terms) if self.n else np.zeros(0, np.uint32)
        tf = np.concatenate(counts).astype(np.float32) if self.n else np.zeros(0, np.float32)
        order = np.argsort(term, kind="stable")
        self.doc = doc[order]
        _, self.first, df = np.unique(term[order], return_index=True, return_counts=True)
        self.last = self.first + df
        number = np.empty(len(term), np.int64)
        number[order] = np.repeat(np.arange(len(df)), df)
        norm = k1 * (1 - b + b * lengths / max(1.0, lengths.mean() if self.n else 1.0))
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5)).astype(np.float32)
        weight = tf * (k1 + 1) / (tf + norm[doc].astype(np.float32))
        self.weight = weight[order] * np.repeat(idf, df)
        at = np.cumsum([0, *(len(t) for t in terms)])
        self.query = []  # for each document its words that another document has too
        self.own = []  # and their weights
        back = np.empty(len(term), np.float32)
        back[order] = self.weight
        for i in range(self.n):
            own = number[at[i] : at[i + 1]]
            shared = df[own] > 1
            self.query.append(own[shared])
            self.own.append(back[at[i] : at[i + 1]][shared])
        self.held = np.array([len(q) for q in self.query], np.int64)
        self.asked = np.zeros(len(df), bool)

    def scores(self, i: int, open_: np.ndarray | None = None) -> np.ndarray:
        """Scores of the documents ``open_`` (numbers in order; all by default) for the words of document ``i``; 0 for all others.

        Read from the documents where those are short together, else from the postings. Either way a document's
        weights are added in order of the words, so the sums are the same.
        """
        query, open_ = self.query[i], np.arange(self.n) if open_ is None else open_
        if not len(query) or not len(open_):
            return np.zeros(self.n)
        postings = int((self.last[query] - self.first[query]).sum())
        if int(self.held[open_].sum()) + PER_DOCUMENT * len(open_) < postings:
            self.asked[query] = True
            hit = self.asked[np.concatenate([self.query[d] for d in open_])]
            self.asked[query] = False
            return np.bincount(np.repeat(open_, self.held[open_])[hit], np.concatenate([self.own[d] for d in open_])[hit], self.n)
        spans = [slice(self.first[t], self.last[t]) for t in query]
        out = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        shut = np.ones(self.n, bool)
        shut[open_] = False
        out[shut] = 0
        return out

    def only(self, kept: np.ndarray) -> "Index":
        """The index with the postings of the documents in the mask ``kept`` alone, at the weights they have."""
        out = object.__new__(Index)
        out.__dict__.update(self.__dict__)
        at = kept[self.doc]
        left = np.concatenate([[0], np.cumsum(at)])
        out.doc, out.weight, out.first, out.last = self.doc[at], self.weight[at], left[self.first], left[self.last]
        return out


def fill(sizes: np.ndarray, index: Index, capacity: int) -> list[tuple[list[int], int]]:
    """Containers as lists of item numbers, the seed first, then the retrieved, then those that only fit; and how many
    are seed or retrieved. Every size is at most ``capacity``."""
    n = len(sizes)
    by_size = np.lexsort((-np.arange(n), sizes))  # of equal sizes the smallest id comes last and is taken first
    place = np.empty(n, np.int64)
    place[by_size] = np.arange(n)
    sorted_sizes = sizes[by_size]
    below = list(range(-1, n))  # below[p + 1]: the last unused place up to p, by path compression; 0 stands for none
    below[0] = 0
    below[1:] = range(1, n + 1)
    used = np.zeros(n, bool)

    def unused(p: int) -> int:
        p += 1
        root = p
        while below[root] != root:
            root = below[root]
        while below[p] != root:
            below[p], p = root, below[p]
        return root - 1

    def take(i: int) -> None:
        used[i] = True
        below[place[i] + 1] = place[i]

    out, indexed = [], n
    while (p := unused(n - 1)) >= 0:
        seed = int(by_size[p])
        take(seed)
        room, members, found = capacity - int(sizes[seed]), [seed], 1
        smallest = int(sorted_sizes[0])
        if room >= smallest:
            if 2 * (left := n - int(used.sum())) <= indexed:  # the postings of what is used are dropped at each halving
                index, indexed = index.only(~used), left
            score = index.scores(seed, np.flatnonzero(~used & (sizes <= room)))
            near = np.flatnonzero(score)
            near = near[np.lexsort((near, -score[near]))]
            fits = np.flatnonzero(sizes[near] <= room)
            while len(fits):  # the best neighbour that fits, then on from there
                near = near[fits]
                i = int(near[0])
                take(i)
                members.append(i)
                room -= int(sizes[i])
                near = near[1:]
                fits = np.flatnonzero(sizes[near] <= room)
            found = len(members)
            while room >= smallest and (p := unused(int(np.searchsorted(sorted_sizes, room, "right")) - 1)) >= 0:
                i = int(by_size[p])
                take(i)
                members.append(i)
                room -= int(sizes[i])
        out.append((members, found))
    return out


def _packed(batches: Iterator[pd.DataFrame], limits: list[tuple[str, int]], shard: int) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PACKED.split(", ")]
    held: list[pd.DataFrame] = []

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        terms = [np.frombuffer(t, np.uint32) for t in rows["terms"]]
        counts = [np.frombuffer(c, np.uint32) for c in rows["counts"]]
        index = Index(terms, counts, rows["length"].to_numpy(float))
        ids, tokens = rows["id"].to_numpy(), rows["n_tokens"].to_numpy()
        out = []
        for name, capacity in limits:
            whole = np.where(tokens > capacity, tokens // capacity, 0)
            rest = tokens - whole * capacity
            for i in np.flatnonzero(whole):  # only a document above the capacity is split
                out.extend((name, capacity, f"{ids[i]}.{part}", ids[i], part, part * capacity, capacity, "split") for part in range(whole[i]))
            open_items = np.flatnonzero((rest > 0) | (tokens == 0))
            part_index = index if len(open_items) == len(rows) else Index([terms[i] for i in open_items], [counts[i] for i in open_items], rows["length"].to_numpy(float)[open_items])
            for members, found in fill(rest[open_items], part_index, capacity):
                seed = open_items[members[0]]
                key = f"{ids[seed]}.{whole[seed]}"
                how = ["seed", *["retrieved"] * (found - 1), *["filled"] * (len(members) - found)]
                out.extend((name, capacity, key, ids[i], whole[i], whole[i] * capacity, rest[i], h) for i, h in zip(open_items[members], how))
        return pd.DataFrame(out, columns=names)

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= 2 * shard:
            rows = pd.concat(held, ignore_index=True)
            held = [rows.iloc[shard:]]
            yield pack(rows.iloc[:shard])
    rows = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(rows):
        yield pack(rows)


def pack(docs: DataFrame, doc_id: Column, text: Column, limits: list[tuple[str, int]], locality: list[Column] | None = None, vocabulary: str = VOCABULARY, shard: int = SHARD) -> DataFrame:
    """Every document, for every (name, capacity) of ``limits``, in a container (schema ``PACKED``).

    A container's id is its seed document and part. A document above the capacity is cut into full
    containers of its own and a rest that is packed like any item; no other document is split.

    Defined results: null ids and null texts take no part; an empty text has size 0 and lies in some
    container; repeated rows of one id count once; ties are broken by id; a capacity that is null or
    below 1 raises ValueError; an empty table or no limits give no rows. Other columns play no part.
    """
    if any(c is None or c < 1 for _, c in limits):
        raise ValueError("capacities must be at least 1")
    places = [c.cast("string") for c in locality or []]
    rows = docs.select(doc_id.cast("long").alias("id"), text.alias("t"), F.array(*places or [F.lit("")]).alias("place")).where("id is not null and t is not null").select("id", "place", "t")
    sized = rows.mapInPandas(lambda it: _sized(it, vocabulary), SIZED)
    of_one = F.min_by(F.struct("n_tokens", "length", "terms", "counts"), F.struct("place", "n_tokens", "length")).alias("x")
    sized = cut(sized.groupBy("id").agg(F.min("place").alias("place"), of_one).select("id", "place", "x.*"), "sized")
    n = sized.count()
    shards = sized.repartitionByRange(max(1, -(-n // shard)), "place", "id").sortWithinPartitions("place", "id")
    return shards.drop("place").mapInPandas(lambda it: _packed(it, limits, shard), PACKED)


def fill_report(packed: DataFrame) -> DataFrame:
    """limit_name, capacity, n_containers, n_tokens, unused_share, and the shares of all tokens that lie in split
    documents (split_share), were retrieved for their seed (retrieved_share) or only fitted (filled_share)."""
    per = packed.groupBy("limit_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"), *(F.sum(F.when(F.col("how") == h, F.col("n_tokens")).otherwise(0)).alias(h) for h in ("split", "retrieved", "filled")))
    out = per.groupBy("limit_name", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("t").alias("n_tokens"), *(F.sum(h).alias(h) for h in ("split", "retrieved", "filled")))
    shares = {f"{h}_share": F.when(F.col("n_tokens") > 0, F.col(h) / F.col("n_tokens")).otherwise(0.0) for h in ("split", "retrieved", "filled")}
    return out.withColumns({"unused_share": 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), **shares}).drop("split", "retrieved", "filled")


def packing_checks(packed: DataFrame) -> DataFrame:
    """Per limit what a packing must keep: n_documents, n_over (containers above the capacity), n_twice (document parts
    that overlap or leave a gap) and n_split (documents cut although they fit)."""
    containers = packed.groupBy("limit_name", "capacity", "container_id").agg(F.sum("n_tokens").alias("t"))
    over = containers.groupBy("limit_name", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("n_over"))
    docs = packed.groupBy("limit_name", "capacity", "doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("t"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count_distinct("part").alias("kinds"))
    whole = docs.groupBy("limit_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if((F.col("t") != F.col("end")) | (F.col("kinds") != F.col("parts"))).alias("n_twice"), F.count_if((F.col("parts") > 1) & (F.col("t") <= F.col("capacity"))).alias("n_split")
    )
    return whole.join(over, ["limit_name", "capacity"])
