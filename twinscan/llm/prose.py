"""Per-document text statistics that tell speech in sentences from lists, tables and junk.

Method: thresholds on statistics of a cue and of its whole document (word count, mean word length, symbol ratio,
ended lines, common words, and the shapes of lines) are noisy labelling functions, each speaking for one text type.
They overlap and contradict each other. The vote patterns of all cues are counted, and expectation-maximisation on those counts
learns how often every function fires under every type and the share of the types: a function that fires without the
company its type keeps loses its say. The posterior of a cue's pattern gives its text type. Only the table of
distinct patterns leaves the executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("speech", "notice", "list", "table", "junk")
# The type each labelling function speaks for.
RULES = {
    "sentence_end": "speech",
    "common_words": "speech",
    "running_words": "speech",
    "plain_words": "speech",
    "sound": "notice",
    "advert": "notice",
    "marked_items": "list",
    "separated_items": "list",
    "leader_dots": "list",
    "names_only": "list",
    "column_gaps": "table",
    "number_cells": "table",
    "field_marks": "table",
    "symbols": "junk",
    "foreign_signs": "junk",
    "unbroken_code": "junk",
    "unpronounceable": "junk",
    "drawing": "junk",
    "karaoke": "junk",
    "document_ended": "speech",
    "document_common": "speech",
    "document_symbols": "junk",
    "document_long_words": "junk",
    "document_few_words": "table",
}
CUE_RULES = [n for n in RULES if not n.startswith("document_")]
MOST_PATTERNS = 1 << 20
PRIOR = 20.0  # cues that the start of the learning counts for
STATS = "doc_id long, n_cues long, n_lines long, n_words long, word_chars long, n_common long, n_symbols long, n_chars long, n_ended long, codes array<int>"

_TAGS = re.compile(r"</?[A-Za-z][^<>\n]*>|\{\\[^{}\n]*\}")
_KARAOKE = re.compile(r"\{\\k[fo]?\d+\}")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SYMBOL = re.compile(r"[^\w\s]")
_END = re.compile(r"[.!?…,:;–-][\"'»”’)\]]*\s*\Z")
_ITEM = re.compile(r"[ \t]*(?:[-–—•*·▪◦]|\d{1,3}[.):]|[a-zA-Z][.)](?=\s))[ \t]*\S")
_GAP = re.compile(r"\S(?: {2,}| *\t+ *| +\| +)\S")
_NUMBER = re.compile(r"(?<![\w.,])[-+]?\d+(?:[.,:/-]\d+)*%?(?![\w])")
_FIELDS = re.compile(r"[^\s;|\t]+(?: ?[;|\t] ?[^\s;|\t]+){2,}\s*\Z")
_DOTS = re.compile(r"\S ?(?:\.{4,}|(?: \.){3,}|…{2,}) ?\S")
_SOUND = re.compile(r"\s*[-–]?\s*(?:\[[^\[\]]*\]|\([^()]*\)|♪.*♪|#[^#]*#|\*[^*\n]*[^\W\d_][^*\n]*\*)\s*\Z", re.S)
_NOTICE = re.compile(r"\bwww\.|https?://|\.(?:com|org|net|example|test|invalid)\b|@\w+\.", re.I)
# How subtitlers sign their work.
_CREDIT = re.compile(r"\s*(?:subtitles?|captions?|subtítulos|sous-titres|legendas|untertitel|sync\w*|sincron\w*|korrigiert|corri\w*|corrected|translated|tradu\w*|übersetz\w*|relu|revis\w*|bearbeitet|best watched with|ripped|encoded)\b", re.I)
_DRAWING = re.compile(r"\s*m(?:\s+-?\d+(?:\.\d+)?){2}\s+[lbnsc]\b")
_CODE = re.compile(r"(?=\S*\d)(?=\S*[a-z])(?=\S*[A-Z])[A-Za-z0-9+/=_-]{16,}")
_TWO_BYTES = re.compile("[\xc2-\xf4][\x80-\xbf]")
_DOT_WORD = re.compile(r"\.\w|//|@|[wW]{3}\.")
_LOST = re.compile("[�?¿½-]{3,}")
_STROKES = re.compile(r"[lI1|!.,i\s]+\Z")
_CLUSTER = re.compile(r"[bcdfghjklmnpqrstvwxzçßñ]{5,}|\A[bcdfghjklmnpqrstvwxz]{3,}\Z|[bcdfghjkmnpqrtvwxz]{4,}|q(?!u)|[jvqx][bcdfghjklmnpqrstvwxz]|[bcdfghjkmpqtvwxz][jvx]")


def cues(text: str) -> list[list[str]]:
    """The text lines of every cue; a cue begins at a line holding ``-->``.

    The blank line and the cue number before the next timing line belong to neither cue.
    """
    out: list[list[str]] = []
    body: list[str] | None = None
    for line in text.split("\n"):
        if "-->" in line:
            if body is not None:
                _trim(body, True)
            body = []
            out.append(body)
        elif body is not None:
            body.append(line.rstrip("\r"))
    if body is not None:
        _trim(body, False)
    return out


def _trim(body: list[str], number: bool) -> None:
    if number and body and body[-1].strip().isdigit() and (len(body) == 1 or not body[-2].strip()):
        body.pop()
    while body and not body[-1].strip():
        body.pop()


def repaired(text: str) -> str:
    """The text with UTF-8 that was read as Latin-1, once or twice, put right; otherwise unchanged."""
    for _ in range(2):
        if text.isascii() or not _TWO_BYTES.search(text):
            break
        try:
            text = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            break
    return text


def votes(lines: list[str], raw: str, by_line: list[int], words: list[str], common: list[str], symbols: int) -> int:
    """Bit pattern, in the order of ``RULES``, of the labelling functions that fire on one cue."""
    text = "\n".join(lines)
    n = len(text.replace(" ", "").replace("\n", ""))
    if not n:
        return 0
    letters, known = sum(map(len, words)), sum(map(len, common))
    ended = _END.search(text) is not None
    longest = max(by_line)
    # The plain tests before a pattern are implied by it and spare most cues the search.
    gaps = ("  " in text or "\t" in text or "|" in text) and all(_GAP.search(x) for x in lines)
    sound = _SOUND.match(text) is not None
    digits = any(c.isdigit() for c in text)
    items = not sound and all(_ITEM.match(x) for x in lines) and not any(_END.search(x) for x in lines)
    odd = sum(len(w) for w in words if len(w) >= 2 and _CLUSTER.search(w.lower())) if letters >= 8 and not ended else 0
    foreign = 0 if text.isascii() else sum(c == "\ufffd" or "\x80" <= c <= "\xbf" or c in "×÷" for c in text)
    parts = 0
    if not ended and len(words) >= 3:
        for mark in (", ", " / ", " · ", " - "):
            if mark not in text and "\n" not in text:
                continue
            split = text.replace("\n", " ").split(mark)
            if len(split) >= 3 and all(len(p.split()) <= 3 for p in split):
                parts = len(split)
    dots = (".." in text or " ." in text or "…" in text) and _DOTS.search(text) is not None
    karaoke = "{" in raw and _KARAOKE.search(raw) is not None
    fields = (";" in text or "|" in text or "\t" in text) and all(_FIELDS.match(x) for x in lines)
    strange = odd and odd >= 0.5 * letters and known <= 0.2 * letters
    names = len(words) >= 2 and not ended and letters >= 0.6 * n and all(w[0].isupper() and (w[1:].islower() or len(w) == 1) for w in words)
    strokes = letters < 0.7 * n and n >= 4 and _STROKES.match(text) is not None
    code = len(words) <= 30 and max(map(len, text.split())) >= 16 and _CODE.search(text) is not None
    fired = (
        ended and letters >= 0.6 * n,
        known >= 0.25 * n and len(common) >= 2,
        longest >= 4 and letters >= 0.7 * n,
        letters >= 0.9 * n,
        sound,
        _DOT_WORD.search(text) and _NOTICE.search(text) or _CREDIT.match(text),
        items,
        parts,
        dots,
        names,
        gaps and not sound,
        digits and letters < 0.6 * n and not ended and len(_NUMBER.findall(text)) >= 2,
        fields,
        not sound and symbols >= 0.4 * n or strokes,
        not sound and n >= 3 and foreign >= 0.15 * n or letters < 0.4 * n and _LOST.search(text),
        code,
        strange,
        _DRAWING.match(text),
        karaoke,
    )
    return sum(1 << i for i, x in enumerate(fired) if x)


def document_votes(n_lines: int, n_words: int, word_chars: int, n_common: int, n_symbols: int, n_chars: int, n_ended: int) -> int:
    """Bits of the labelling functions on the statistics of a whole document, which count for each of its cues."""
    fired = (
        n_ended >= 0.5 * n_lines,  # true of a document without lines, which has no cues to vote for
        n_common >= 0.25 * n_words > 0,
        n_symbols >= 0.2 * n_chars > 0,
        word_chars >= 9 * n_words > 0,
        n_words < n_lines,
    )
    return sum(1 << (len(CUE_RULES) + i) for i, x in enumerate(fired) if x)


def _measured(batches: Iterator[pd.DataFrame], common: frozenset[str]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in STATS.split(", ")]
    for batch in batches:
        rows = []
        for doc, text in zip(batch["id"], batch["text"]):
            n_lines = n_words = word_chars = n_common = n_symbols = n_chars = n_ended = 0
            codes = []
            for body in cues(text or ""):
                raw = repaired("\n".join(body))
                lines = [x for x in (_TAGS.sub("", raw) if "<" in raw or "{" in raw else raw).split("\n") if x.strip()]
                clean = "\n".join(lines)
                found = [_WORD.findall(x) for x in lines]
                words = [w for x in found for w in x]
                known = [w for w in words if w.lower() in common]
                symbols = len(_SYMBOL.findall(clean))
                codes.append(votes(lines, raw, [len(x) for x in found], words, known, symbols))
                n_lines += len(lines)
                n_words += len(words)
                word_chars += sum(map(len, words))
                n_common += len(known)
                n_symbols += symbols
                n_chars += len(clean)
                n_ended += sum(_END.search(x) is not None for x in lines)
            fired = document_votes(n_lines, n_words, word_chars, n_common, n_symbols, n_chars, n_ended)
            codes = [c | fired if c else 0 for c in codes]  # a cue without text has no votes
            rows.append((doc, len(codes), n_lines, n_words, word_chars, n_common, n_symbols, n_chars, n_ended, codes))
        yield pd.DataFrame(rows, columns=names)


def measure(docs: DataFrame, doc_id: Column, text: Column, common_words: list[str]) -> DataFrame:
    """Counts and the vote pattern of every cue, per document (schema ``STATS``); a map without a shuffle.

    Defined results: a null id takes no part; a null or empty text, or one without cues, has no cues and
    zero counts; whole texts are read whatever their length; repeated rows come out once each; an empty
    table gives no rows. Other columns play no part.
    """
    known = frozenset(w.lower() for w in common_words if w)
    rows = docs.select(doc_id.cast("long").alias("id"), text.alias("text")).where("id is not null")
    return rows.mapInPandas(lambda it: _measured(it, known), STATS)


def learn(codes: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of every type for every vote pattern, how often each function fires under each type, shares of the types).

    Expectation-maximisation on the counts of the patterns. Under its type, each function fires or stays silent by a
    chance of its own, so silence counts too. The start is what the functions are meant to say: half of the
    cues of their type, few of the others. Each round re-estimates the chances and the shares from the
    posteriors, with a weak prior on the start; a function never fires more often under another type than under
    its own, which keeps the types what they are called. A pattern without a vote is speech.
    """
    bits = ((codes[:, None] >> np.arange(len(RULES))) & 1).astype(float)
    own = np.array([[float(t == kind) for kind in RULES.values()] for t in TYPES])
    start = np.where(own > 0, 0.5, 0.03)
    of_cue = own * [n in CUE_RULES for n in RULES]
    forms = [TYPES.index("list"), TYPES.index("table")]
    of_cue[forms] = of_cue[forms].max(axis=0)  # laid out in items or columns: a function for the one admits the other
    possible = (bits @ of_cue.T > 0) | (np.array(TYPES) == "speech")
    fires, share = start, np.array([0.5, *[0.5 / (len(TYPES) - 1)] * (len(TYPES) - 1)])
    post = np.zeros((len(codes), len(TYPES)))
    for _ in range(rounds):
        log = np.log(share) + bits @ np.log(fires).T + (1 - bits) @ np.log1p(-fires).T
        log = np.where(possible, log, -np.inf)
        post = np.exp(log - log.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        mass = post * counts[:, None]
        total = mass.sum(axis=0)
        fires = (mass.T @ bits + PRIOR * start) / (total[:, None] + PRIOR)
        fires = np.clip(np.minimum(fires, (fires * own).sum(axis=0)), 1e-4, 1 - 1e-4)
        share = (total + PRIOR) / (total.sum() + PRIOR * len(TYPES))
    return post, fires, share


def text_types(measured: DataFrame) -> DataFrame:
    """doc_id, n_cues, for every type the number of its cues n_speech, n_notice (sounds, adverts), n_list, n_table, n_junk,
    and the document's posterior p_speech... (the mean of its cues'; null without cues).

    ``measured`` is read twice, so it should be a written table. A cue counts for its likeliest type. Patterns
    are a small table that every task looks up; more than MOST_PATTERNS of them raise an error.
    """
    spark = measured.sparkSession
    cue = measured.select("doc_id", F.explode("codes").alias("code"))
    patterns = cue.groupBy("code").count().orderBy("code").limit(MOST_PATTERNS + 1).toPandas()
    if len(patterns) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} vote patterns")
    codes = patterns["code"].to_numpy(np.int64)
    post = learn(codes, patterns["count"].to_numpy(float))[0] if len(codes) else np.zeros((0, len(TYPES)))
    post = post.astype(np.float32)  # in the order of the codes, which are sorted
    names = ["doc_id", "n_cues", *(f"n_{t}" for t in TYPES), *(f"p_{t}" for t in TYPES)]

    def typed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, own in zip(batch["doc_id"], batch["codes"]):
                if len(own):
                    p = post[np.searchsorted(codes, own)]
                    rows.append((doc, len(own), *np.bincount(p.argmax(axis=1), minlength=len(TYPES)).tolist(), *p.mean(axis=0, dtype=np.float64).tolist()))
                else:
                    rows.append((doc, 0, *[0] * len(TYPES), *[None] * len(TYPES)))
            yield pd.DataFrame(rows, columns=names)

    schema = ", ".join(["doc_id long", "n_cues long", *(f"n_{t} long" for t in TYPES), *(f"p_{t} double" for t in TYPES)])
    return measured.select("doc_id", "codes").mapInPandas(typed, schema)


def statistics(measured: DataFrame) -> DataFrame:
    """doc_id, n_cues, word_count, mean_word_length, symbol_ratio, ended_share, common_share (0 where nothing to divide by)."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return measured.select(
        "doc_id",
        "n_cues",
        F.col("n_words").alias("word_count"),
        per("word_chars", "n_words").alias("mean_word_length"),
        per("n_symbols", "n_chars").alias("symbol_ratio"),
        per("n_ended", "n_lines").alias("ended_share"),
        per("n_common", "n_words").alias("common_share"),
    )
