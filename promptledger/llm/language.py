"""Language of words and documents by a linear-chain conditional random field.

States are the learned languages. A word's features are its prefixes, suffixes,
character n-grams and the word itself where it is in the learned lexicon; a
transition weight joins neighbouring words. Forward-backward gives each word's
probabilities, also in code-switched text; a document's language is the one
with the greatest mean over its words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, table, written

BUCKETS = 1 << 15
#: Words of one chain; longer texts are several chains.
CHAIN = 64
#: Chains of each language that the fit takes at most (by a hash), from documents of
#: which it takes at most DOCS_PER_LANGUAGE; of very many languages each has fewer
#: chains, so that all have MAX_CHAINS about, and one at least.
CHAINS_PER_LANGUAGE = 500
DOCS_PER_LANGUAGE = 1000
MAX_CHAINS = 32_000
LEXICON_LEAST = 3
EPOCHS = 6
RATE = 0.4
DECAY = 1e-4
#: Numbers of word scores (words times languages) that a worker remembers and that it works on at once.
MAX_REMEMBERED = 1_200_000
BATCH_SCORES = 600_000
#: Numbers of pair marginals (chains times languages squared) of one step of the fit.
BATCH_PAIRS = 4_000_000
#: A longer run of letters is several words.
MAX_WORD = 40

WORD = re.compile(r"[^\W\d_]+")
#: Shares of the languages are broadcast up to so many.
BROADCAST_LANGUAGES = 10_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters, those over MAX_WORD letters in parts: no letter is left out."""
    words = WORD.findall(text.lower()) if text else []
    if words and max(map(len, words)) > MAX_WORD:
        return [w[k : k + MAX_WORD] for w in words for k in range(0, len(w), MAX_WORD)]
    return words


def word_features(word: str, lexicon: frozenset[str]) -> list[int]:
    mask = BUCKETS - 1
    b = f"<{word}>".encode("utf-32-le", "surrogatepass")
    out = [crc32(b[: 4 * n], 1) & mask for n in (2, 3, 4)] + [crc32(b[-4 * n :], 2) & mask for n in (2, 3, 4)]
    for n in (1, 2, 3):
        out += [crc32(b[i : i + 4 * n], 3 + n) & mask for i in range(0, len(b) - 4 * n + 1, 4)]
    if word in lexicon:
        out.append(crc32(b, 9) & mask)
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (BUCKETS, languages)
    transitions: np.ndarray  # (languages, languages)
    start: np.ndarray
    lexicon: frozenset[str]


def forward_backward(emit: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (chains, steps, states) and summed pair marginals of padded chains."""
    n, steps, states = emit.shape
    a = np.exp(transitions - transitions.max())
    local = np.exp(emit - emit.max(2, keepdims=True))
    live = np.arange(steps)[None, :] < lengths[:, None]
    ahead = np.empty_like(local)
    p = local[:, 0] * np.exp(start - start.max())
    ahead[:, 0] = p / p.sum(1, keepdims=True)
    for t in range(1, steps):
        p = (ahead[:, t - 1] @ a) * local[:, t]
        ahead[:, t] = p / p.sum(1, keepdims=True)
    marginal = np.zeros_like(local)
    pairs = np.zeros((states, states))
    back = np.ones((n, states))
    for t in range(steps - 1, -1, -1):
        p = ahead[:, t] * back
        marginal[:, t] = p / p.sum(1, keepdims=True)
        if t:
            behind = local[:, t] * back
            both = live[:, t]
            if both.any():
                joint = ahead[both, t - 1, :, None] * a[None] * behind[both, None, :]
                pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            new = behind @ a.T
            back = np.where(both[:, None], new / new.sum(1, keepdims=True), 1.0)
    marginal *= live[:, :, None]
    return marginal, pairs


def marginals(emit: np.ndarray, transitions: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Summed marginals of each chain (chains, states), as ``forward_backward`` gives."""
    n, steps, states = emit.shape
    a = np.exp(transitions - transitions.max())
    local = np.exp(emit - emit.max(2, keepdims=True)).transpose(1, 0, 2).copy()
    ahead = np.empty_like(local)
    p = local[0] * np.exp(start - start.max())
    ahead[0] = p / p.sum(1, keepdims=True)
    for t in range(1, steps):
        p = (ahead[t - 1] @ a) * local[t]
        ahead[t] = p / p.sum(1, keepdims=True)
    out = np.zeros((n, states))
    back = np.ones((n, states))
    for t in range(steps - 1, -1, -1):
        live = (t < lengths)[:, None]
        p = ahead[t] * back
        out += np.where(live, p / p.sum(1, keepdims=True), 0.0)
        if t:
            new = (local[t] * back) @ a.T
            back = np.where(live, new / new.sum(1, keepdims=True), 1.0)
    return out


def fit_chains(chains: list[tuple[list[str], str]], seed: int = 11) -> LanguageModel:
    """SGD on the conditional likelihood of (words, language) chains.

    Half of the chains are spliced from two, so that switches are seen.
    """
    languages = sorted({lang for _, lang in chains})
    states = len(languages)
    rng = np.random.default_rng(seed)
    seen: Counter[str] = Counter()
    for words, _ in chains:
        seen.update(set(words))
    lexicon = frozenset(w for w, n in seen.items() if n >= LEXICON_LEAST)
    distinct = {w: k for k, w in enumerate(seen)}
    of_word = [word_features(w, lexicon) for w in distinct]
    sizes = np.array([len(x) for x in of_word], np.int64)
    flat = np.concatenate(of_word) if of_word else np.zeros(0, int)
    owner = np.repeat(np.arange(len(of_word)), sizes)
    weights = np.zeros((BUCKETS, states))
    grown = np.full((BUCKETS, states), 1e-2)
    transitions, start = np.zeros((states, states)), np.zeros(states)
    number = {lang: k for k, lang in enumerate(languages)}
    coded = [(np.array([distinct[w] for w in words]), np.full(len(words), number[lang])) for words, lang in chains if words]
    for _ in range(EPOCHS if states > 1 else 0):
        order = rng.permutation(len(coded))
        rows = []
        for k, other in zip(order, rng.permutation(len(coded))):
            (w, y), (v, z) = coded[k], coded[other]
            if rng.random() < 0.5:
                cut, cut2 = int(rng.integers(0, len(w) + 1)), int(rng.integers(0, len(v) + 1))
                w, y = np.concatenate([w[:cut], v[cut2:]])[:CHAIN], np.concatenate([y[:cut], z[cut2:]])[:CHAIN]
            if len(w):
                rows.append((w, y))
        size = max(1, min(250, BATCH_PAIRS // states**2))
        for at in range(0, len(rows), size):
            part = rows[at : at + size]
            lengths = np.array([len(w) for w, _ in part])
            steps = int(lengths.max())
            words = np.zeros((len(part), steps), int)
            gold = np.zeros((len(part), steps, states))
            for k, (w, y) in enumerate(part):
                words[k, : len(w)] = w
                gold[k, np.arange(len(w)), y] = 1
            used = np.unique(words)
            scores = np.zeros((len(of_word), states))
            pick = np.isin(owner, used)
            for s in range(states):
                scores[:, s] = np.bincount(owner[pick], weights[flat[pick], s], len(of_word))
            marginal, pairs = forward_backward(scores[words], transitions, start, lengths)
            gap = gold - marginal
            live = np.arange(steps)[None, :] < lengths[:, None]
            seen_pairs = np.zeros_like(pairs)
            for k, (_, y) in enumerate(part):
                np.add.at(seen_pairs, (y[:-1], y[1:]), 1)
            for s in range(states):
                by_word = np.bincount(words[live], gap[:, :, s][live], len(of_word))
                g = np.bincount(flat[pick], by_word[owner[pick]], BUCKETS) / len(part) - DECAY * weights[:, s]
                grown[:, s] += g * g
                weights[:, s] += RATE * g / np.sqrt(grown[:, s])
            transitions += 0.02 * ((seen_pairs - pairs) / len(part) - DECAY * transitions)
            start += 0.02 * gap[:, 0].mean(0)
    return LanguageModel(languages, weights, transitions, start, lexicon)


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from text and non-null lang of documents whose crc32(doc_id) mod 4 is not 2.

    At most DOCS_PER_LANGUAGE documents of each language and CHAINS_PER_LANGUAGE of
    their chains, both by smallest hash (see MAX_CHAINS). Null ids are not learned from.
    """
    rows = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    counts = written(rows.groupBy("lang").count(), "languages")
    languages = counts.count()
    most = max(1, min(CHAINS_PER_LANGUAGE, MAX_CHAINS // max(1, languages)))

    def chains(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc_id, text, lang in pdf[["doc_id", "text", "lang"]].itertuples(index=False):
                words = words_of(text)
                parts = [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]
                if parts:
                    yield pd.DataFrame({"lang": lang, "h": [crc32(f"{doc_id}:{i}".encode()) for i in range(len(parts))], "words": [" ".join(p) for p in parts]})

    # a hash bound keeps about twice the wanted documents of each language; limit and order make the rest exact
    share = counts.select("lang", F.least(F.lit(1.0), F.lit(2.0 * DOCS_PER_LANGUAGE) / F.col("count")).alias("share"))
    picked = rows.join(F.broadcast(share) if languages <= BROADCAST_LANGUAGES else share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= F.col("share") * 1_000_003)
    found = picked.mapInPandas(chains, "lang string, h long, words string")
    cut = found.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(64)))
    got = [(r["words"].split(" "), r["lang"]) for r in _smallest(cut, most).collect()]
    return fit_chains(sorted(got, key=lambda x: (x[1], x[0])))


def _smallest(chains: DataFrame, most: int) -> DataFrame:
    """The ``most`` chains of smallest hash for each language, first within 64 parts of it."""
    near = chains.withColumn("rn", F.row_number().over(Window.partitionBy("lang", "part").orderBy("h", "words"))).where(F.col("rn") <= most)
    return near.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "words"))).where(F.col("rn") <= most)


def label(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; ``und`` and 0 for a text without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        states = len(m.languages)
        most_known, most_words = max(1, MAX_REMEMBERED // max(1, states)), max(CHAIN, BATCH_SCORES // max(1, states))
        known: dict[str, int] = {}
        scores = np.zeros((0, states))

        def learn(words: set[str]) -> None:
            nonlocal scores
            new = list(words)
            own = [word_features(w, m.lexicon) for w in new]
            sizes = np.array([len(x) for x in own])
            sums = np.add.reduceat(m.weights[np.concatenate(own)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            lettered = np.array([any(map(str.isalpha, w)) for w in new])
            for w, k, ok in zip(new, range(len(known), len(known) + len(new)), lettered):
                known[w] = k if ok else -1 - k
            if len(known) > len(scores):
                scores = np.concatenate([scores, np.zeros((max(len(known) * 2, 4096) - len(scores), states))])
            scores[len(known) - len(new) : len(known)] = sums

        def flush(codes: list[np.ndarray]) -> list[tuple[str, float]]:
            """Labels of texts given as word numbers."""
            out: list[tuple[str, float]] = []
            sizes = [len(c) for c in codes]
            chains_of = [-(-n // CHAIN) for n in sizes]
            total = sum(chains_of)
            if not total or not states:
                return [("und", 0.0)] * len(codes)
            grid = np.zeros((total, CHAIN), np.int64)
            lengths = np.full(total, CHAIN)
            at = 0
            for c, k in zip(codes, chains_of):
                if k:
                    grid[at : at + k].reshape(-1)[: len(c)] = c
                    lengths[at + k - 1] = len(c) - (k - 1) * CHAIN
                at += k
            sums = marginals(scores[grid], m.transitions, m.start, lengths)
            at = 0
            for n, k in zip(sizes, chains_of):
                if not n:
                    out.append(("und", 0.0))
                    continue
                mean = sums[at : at + k].sum(0) / n
                best = int(mean.argmax())
                out.append((m.languages[best], float(min(1.0, mean[best]))))
                at += k
            return out

        for texts in batches:
            got: list[tuple[str, float]] = []
            waiting: list[np.ndarray] = []
            held = 0
            for text in texts:
                words = words_of(text)
                if len(known) > most_known:
                    got += flush(waiting)
                    waiting, held = [], 0
                    known.clear()
                if new := set(words).difference(known):
                    learn(new)
                c = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                waiting.append(c[c >= 0])
                held += len(words)
                if held > most_words:
                    got += flush(waiting)
                    waiting, held = [], 0
            got += flush(waiting)
            yield pd.DataFrame({"lang_pred": [a for a, _ in got], "score": [b for _, b in got]})

    judged = F.pandas_udf(labelled, "lang_pred string, score double")(F.col("text").cast("string"))
    own = free_name("_judged", docs)
    return docs.withColumn(own, judged).withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)


def op4_language(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``; null ids are not held out and not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return label(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
