"""Telling hand-written source from tool output, minified and vendored files and data held as code.

Method: linear support-vector classification of hashed character n-grams and path components. No labels
are given, so labelling rules (tell-tale comment lines, paths of package folders, the shape of bundles and
data) mark sure cases, the tell-tale lines themselves are masked from the features, and the classifier carries
what it learns from the sure cases to files without any mark. Unmarked files serve as negatives; those the
first fits place firmly among the positives are taken for hidden ones and left out of the next. Validation
is split by repository.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinscan.llm.lexer import language_of, problem
from twinscan.plans.scratch import cut

TEXT_BINS, PATH_BINS = 1 << 13, 1 << 11
SAMPLE = 4000  # most rows of each label the classifier is fitted on

# What generators, compilers and package managers write into header comments.
_TELL = re.compile(
    r"^[ \t]*(?://|/?\*|\#|<!--)[^\n]*?(?:"
    r"code generated by|auto-?generated|generated (?:by|from|automatically)|automatically generated|auto generated|@generated\b(?! stubs)"
    r"|machine[- ](?:written|generated)|generiert von|do not (?:edit|modify)|nicht bearbeiten|edits? will be (?:overwritten|lost)|changes to this file (?:are|will be) lost"
    r"|@license|@preserve|vendored|copied from \S+ v?\d"
    r"|\b(?:MIT|ISC|BSD|Apache-2\.0)\b|v?\d+\.\d+\.\d+|[#@] ?sourceMappingURL"
    r")[^\n]*$|^[ \t]*/\*!?[ \t]*\S+ v?\d+\.\d+[ \t]*\*/",
    re.I | re.M,
)
# Folders and name parts that package managers, bundlers and generators use.
_PATH = re.compile(r"(?:^|/)(?:node_modules|bower_components|vendor|third_party|__generated__|generated)/|[.-]min\.|(?:_pb|\.pb|\.codegen|\.generated|\.g|\.bundle|\.chunk)\.[a-z]+$", re.I)
_COMPILED = re.compile(r'"use strict";\s*Object\.defineProperty\(exports, ?"__esModule"|webpackChunk|__webpack_require__|^[\s;!(]*eval\(function\(p,a,c,k,e|typeof define ?=== ?\'function\' ?&& ?define\.amd')
_LITERAL = re.compile(r"'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|(?<![\w$])-?(?:0x[\da-f]+|[\d_.]+)|[\s,\[\]{}:]+|\b\w+:", re.I)


def clean_path(path: str | None) -> str:
    return (path or "").replace("\\", "/").removeprefix("./")


def sure_case(path: str, text: str) -> str | None:
    """The kind of labelling rule that marks the file as not hand-written, if any. Like ``features``, it reads the whole text."""
    if _TELL.search(text):
        return "header"
    if _PATH.search(path.split("/", 1)[-1]):
        return "path"
    if _COMPILED.search(text):
        return "compiled"
    lines = text.count("\n") + 1
    if len(text) > 400 and len(text) / lines > 200:
        return "long lines"
    return "data" if len(text) > 400 and sum(len(x) for x in _LITERAL.findall(text)) > 0.93 * len(text) else None


_MAP = np.arange(256, dtype=np.uint32)
_MAP[48:58], _MAP[65:91] = 48, 65  # any digit, any capital
_MAP[[9, 13]] = 32


def _grams(data: bytes, n: int, bins: int) -> np.ndarray:
    m = _MAP[np.frombuffer(data, np.uint8)]
    if len(m) < n:
        return np.zeros(0, np.uint32)
    h = np.zeros(len(m) - n + 1, np.uint32)
    for i in range(n):
        h = h * np.uint32(0x01000193) + m[i : i + len(h)]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bins.bit_length() + 1)


def features(path: str, text: str) -> np.ndarray:
    """Unit-length blocks of text 4-grams and of path components with their 3-grams."""
    body = np.bincount(_grams(_TELL.sub("", text).encode("utf-8", "surrogatepass"), 4, TEXT_BINS), minlength=TEXT_BINS).astype(np.float32)
    np.log1p(body, out=body)
    parts = path.lower().split("/")[1:] or [path.lower()]
    names = np.zeros(PATH_BINS, np.float32)
    for i, part in enumerate(parts):
        data = part.encode("utf-8", "surrogatepass")
        place = b"n:" if i == len(parts) - 1 else b"d:"
        if place == b"d:":
            names[zlib.crc32(place + data) % PATH_BINS] += 2
        else:
            names[zlib.crc32(b"e:" + data.rsplit(b".", 1)[-1]) % PATH_BINS] += 1
            names += np.bincount(_grams(b"^" + re.sub(rb"\d+", b"0", data) + b"$", 3, PATH_BINS), minlength=PATH_BINS)
    out = np.concatenate([body / max(1e-9, np.linalg.norm(body)), 0.5 * names / max(1e-9, np.linalg.norm(names)), [1.0]]).astype(np.float32)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 12) -> np.ndarray:
    """Weights of an L2-loss linear support-vector machine by dual coordinate descent; y is +1 or -1."""
    n = len(y)
    cost = np.where(y > 0, c * n / (2.0 * max(1, (y > 0).sum())), c * n / (2.0 * max(1, (y < 0).sum())))
    alpha, w = np.zeros(n), np.zeros(x.shape[1], np.float64)
    diagonal = np.einsum("ij,ij->i", x, x).astype(np.float64) + 0.5 / cost
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, rounds: int = 3) -> tuple[np.ndarray, dict]:
    """Weights and held-out figures. Hidden positives among the negatives are left out round by round."""
    keep = np.ones(len(y), bool)
    for _ in range(rounds):
        w = fit_svm(x[keep & ~held], y[keep & ~held])
        keep = (y > 0) | (x @ w < 0)
    said, true = x[held] @ w > 0, y[held] > 0
    found = float((said & true).sum())
    figures = {"held_out": int(held.sum()), "recall": found / max(1, true.sum()), "precision": found / max(1, said.sum())}
    return fit_svm(x[keep], y[keep]), figures


def held_out(paths: list[str]) -> np.ndarray:
    """Rows of every fourth repository, so that validation shares no repository with fitting."""
    repos = [p.split("/", 1)[0] for p in paths]
    order = sorted(set(repos), key=lambda r: (zlib.crc32(r.encode("utf-8", "surrogatepass")), r))
    held = set(order[::4]) if len(order) > 1 else set()
    return np.array([r in held for r in repos], bool)


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"id": batch["id"], "kind": [sure_case(clean_path(p), t) if t else None for p, t in zip(batch["path"], batch["text"])]})


def _sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of the chosen rows, made where the texts are: only numbers travel to the one task that fits."""
    for batch in batches:
        rows = []
        for rid, path, text, kind in zip(batch["id"], batch["path"], batch["text"], batch["kind"]):
            x = features(clean_path(path), text)
            at = np.flatnonzero(x).astype(np.uint16)
            rows.append((rid, clean_path(path), kind, at.tobytes(), x[at].astype(np.float16).tobytes()))
        yield pd.DataFrame(rows, columns=["id", "path", "kind", "at", "x"])


def _train(batches: Iterator[pd.DataFrame], validate: bool) -> Iterator[pd.DataFrame]:
    names = ["weights", "measure", "held_out", "recall", "precision"]
    held = list(batches)  # at most 2 * SAMPLE rows
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    rows = rows.drop_duplicates("id").sort_values("id")
    sure = rows["kind"].notna().to_numpy()
    if not sure.any() or sure.all():
        yield pd.DataFrame([(b"", "no rows of both labels to fit on", 0, None, None)], columns=names)
        return
    x = np.zeros((len(rows), TEXT_BINS + PATH_BINS + 1), np.float32)
    for i, (at, v) in enumerate(zip(rows["at"], rows["x"])):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float16)
    y = np.where(sure, 1, -1)
    w, figures = fit(x, y, held_out(list(rows["path"])))
    out = [(w.astype(np.float32).tobytes(), "repositories", figures["held_out"], figures["recall"], figures["precision"])]
    for kind in sorted(set(rows["kind"][sure])) if validate else []:
        own = (rows["kind"] == kind).to_numpy()
        if own.all() or not (sure & ~own).any():
            continue
        _, figures = fit(x, y, own)  # the files of one rule, found by what was learned from all others
        out.append((None, f"rule: {kind}", figures["held_out"], figures["recall"], None))
    yield pd.DataFrame(out, columns=names)


def _scored(batches: Iterator[pd.DataFrame], weights: bytes) -> Iterator[pd.DataFrame]:
    w = np.frombuffer(weights, np.float32)
    for batch in batches:
        out = []
        for fid, path, text in zip(batch["id"], batch["path"], batch["text"]):
            path = clean_path(path)
            score = float(features(path, text) @ w) if text and len(w) else None
            language = language_of(path)
            machine = score is not None and score > 0 and not (language and problem(text, language))
            out.append((fid, score, machine))
        yield pd.DataFrame(out, columns=["file_id", "score", "machine"]).astype({"score": "float64"})


def _rows(df: DataFrame, file_id: Column, path: Column, content: Column) -> DataFrame:
    return df.select(file_id.cast("long").alias("id"), path.cast("string").alias("path"), content.alias("text")).where("id is not null")


def _fitted(df: DataFrame, file_id: Column, path: Column, content: Column, sample: int, validate: bool) -> DataFrame:
    rows = _rows(df, file_id, path, content)
    labels = cut(rows.mapInPandas(_label, "id long, kind string"), "labels")  # read twice below
    order = F.xxhash64("id", F.lit(5))
    chosen = labels.where("kind is not null").orderBy(order).limit(sample).unionByName(labels.where("kind is null").orderBy(order).limit(sample)).distinct()
    chosen = rows.where("text <> ''").join(F.broadcast(chosen), "id").mapInPandas(_sparse, "id long, path string, kind string, at binary, x binary")
    return chosen.repartition(1).mapInPandas(lambda it: _train(it, validate), "weights binary, measure string, held_out long, recall double, precision double")


def fit_classifier(df: DataFrame, file_id: Column, path: Column, content: Column, sample: int = SAMPLE) -> bytes:
    """Weights fitted on at most ``sample`` rows of each label (empty where there is nothing to fit on).

    Every row is labelled by the rules; the sample takes the rows of smallest id hash, so it does not
    depend on order or partitioning. Only the weights come to the driver.
    """
    fitted = _fitted(df, file_id, path, content, sample, False).first()
    return bytes(fitted["weights"]) if fitted else b""


def validation(df: DataFrame, file_id: Column, path: Column, content: Column, sample: int = SAMPLE) -> DataFrame:
    """Figures on labelled rows the fit has not seen: measure, held_out (rows), recall, precision.

    ``repositories``: every fourth repository held out. ``rule: x``: the files marked by one labelling rule held out, so
    its recall says how well such files are found without the rule; all of them are positives.
    """
    return _fitted(df, file_id, path, content, sample, True).drop("weights")


def classify(df: DataFrame, file_id: Column, path: Column, content: Column, weights: bytes) -> DataFrame:
    """For every file the classifier's score and the verdict: file_id, score, machine.

    ``machine`` means tool output, minified or bundled, vendored, or mainly data; a file that does not
    parse in its language is never one. The step is a map without a shuffle over the whole texts.

    Defined results: a null id takes no part; a null or empty text has a null score and is not machine;
    a null path has no path features; re-delivered rows come out once each; with nothing to fit on (an
    empty table, or labels of one kind only) every score is null. Other columns play no part.
    """
    return _rows(df, file_id, path, content).mapInPandas(lambda it: _scored(it, weights), "file_id long, score double, machine boolean")
