"""Language identification by cross-parsing against suffix automata.

For each language an automaton accepts every substring of the most frequent words of all
its labelled texts, up to a size; the words are counted by Spark.  A word is parsed greedily into the longest substrings the automaton
accepts; the fewer phrases, the closer the language.  Phrases times the logarithm of the
sample's size, over the letters parsed, estimates the cross entropy, and the language
with the least wins.  Phrases end with their word, so each distinct word of a block is
parsed once, all words and languages side by side.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galeframe.llm.support import extended, mapped, tasks, utf8
from galeframe.llm.words import distinct, doc_blocks, letter_words, lowered, ragged

# Size of an automaton: bytes of the most frequent distinct words of a language.
SAMPLE_BYTES = 40_000
# Longer words are parsed in pieces of this many bytes.
LONG_WORD = 64


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``text``; a symbol below 0
    ends a word: no substring spans it."""
    move: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in text:
        if symbol < 0:
            last = 0
            continue
        known = move[last].get(symbol)
        if known is not None and length[known] == length[last] + 1:
            last = known
            continue
        if known is None:
            new = len(move)
            move.append({})
            length.append(length[last] + 1)
            link.append(0)
        p = last
        while p >= 0 and symbol not in move[p]:
            move[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = move[p][symbol]
            if length[p] + 1 == length[q]:
                target = q
            else:
                target = len(move)
                move.append(dict(move[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = target
                while p >= 0 and move[p].get(symbol) == q:
                    move[p][symbol] = target
                    p = link[p]
            if known is None:
                link[new] = target
            else:
                new = target
        last = new
    return move


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # of each byte; 0 for those no sample has
    move: np.ndarray  # state, symbol -> state; -1 where there is none
    root: np.ndarray  # first state of each language
    weight: np.ndarray  # logarithm of each sample's size

    def phrases(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases of every word in every language (languages by words)."""
        count = np.zeros((len(self.root), len(begin)), np.int32)
        state = np.repeat(self.root[:, None], len(begin), 1)
        size = end - begin
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, "left"))
            symbol = self.symbol[text[begin[:live] + step]]
            now = state[:, :live]
            following = self.move[now, symbol]
            broken = following < 0
            count[:, :live] += broken & (now != self.root[:, None])
            fresh = self.move[self.root][:, symbol]
            # A symbol the sample lacks is a phrase of its own.
            count[:, :live] += broken & (fresh < 0)
            state[:, :live] = np.where(broken, np.where(fresh < 0, self.root[:, None], fresh), following)
        count += state != self.root[:, None]
        out = np.empty_like(count)
        out[:, order] = count
        return out


def fit(samples: dict[str, list[str]], sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from texts by language; the order of the texts does not matter."""
    words: dict[str, list[bytes]] = {}
    for language, texts in sorted(samples.items()):
        found: Counter[bytes] = Counter()
        for text in texts:
            raw = lowered(np.frombuffer(text.encode(), np.uint8))
            begin, end = letter_words(raw, np.zeros(0, np.int64))
            data = raw.tobytes()
            found.update(data[a:b] for a, b in zip(begin.tolist(), end.tolist()))
        chosen, size = [], 0
        for word, _ in sorted(found.items(), key=lambda x: (-x[1], x[0])):
            if size + len(word) > sample_bytes:
                break
            chosen.append(word)
            size += len(word)
        words[language] = chosen
    return _model(words)


def _model(words: dict[str, list[bytes]]) -> Model:
    """The automata of chosen words by language."""
    used = sorted({b for chosen in words.values() for word in chosen for b in word})
    symbol = np.zeros(256, np.int64)
    symbol[used] = np.arange(len(used)) + 1
    tables, roots, weights, states = [], [], [], 0
    for chosen in words.values():
        text: list[int] = []
        for word in chosen:
            text += [int(symbol[b]) for b in word] + [-1]
        moves = suffix_automaton(text)
        table = np.full((len(moves), len(used) + 1), -1, np.int32)
        for k, edges in enumerate(moves):
            for s, to in edges.items():
                table[k, s] = to + states
        tables.append(table)
        roots.append(states)
        weights.append(np.log2(2 + len(text)))
        states += len(moves)
    move = np.concatenate(tables) if tables else np.full((1, 1), -1, np.int32)
    return Model(list(words), symbol, move, np.array(roots, np.int64), np.array(weights))


def _counted(batch: pa.RecordBatch) -> dict | None:
    """(lang, word, n) of the words of a batch, counted by blocks of it."""
    names = batch.column(0).dictionary_encode()
    code = names.indices.to_numpy().astype(np.int64)
    text, offsets = utf8(batch.column(1))
    langs, words, counts = [], [], []
    for a, b in doc_blocks(offsets):
        block = lowered(text[offsets[a] : offsets[b]])
        heads = offsets[a:b] - offsets[a]
        begin, end = letter_words(block, heads[heads < len(block)])
        if not len(begin):
            continue
        owner = np.searchsorted(heads, begin, "right") - 1
        one, kind = distinct(block, begin, end)
        pair, n = np.unique(code[a + owner] * len(one) + kind, return_counts=True)
        word, size = one[pair % len(one)], (end - begin)[one[pair % len(one)]]
        ends = np.append(0, np.cumsum(size)).astype(np.int32)
        data = np.ascontiguousarray(block[ragged(begin[word], size)])
        words.append(pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
        langs.append(names.dictionary.take(pa.array(pair // len(one))))
        counts.append(pa.array(n.astype(np.int64)))
    if not words:
        return None
    return {"lang": pa.concat_arrays(langs), "word": pa.concat_arrays(words), "n": pa.concat_arrays(counts)}


def frequent_words(labelled: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> dict[str, list[bytes]]:
    """The most frequent words of all texts of each language, ``sample_bytes`` of them.

    Ranks are taken in shares of the words first, so no task sees all words of a language;
    the driver gets at most ``sample_bytes`` a language.
    """
    found = mapped(labelled.select("lang", "text"), _counted, "lang string, word binary, n long")
    found = found.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = found.withColumn("_share", F.pmod(F.xxhash64("word"), F.lit(tasks(labelled.sparkSession))))
    for keys in (["lang", "_share"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
        found = found.withColumn("_size", F.sum(F.length("word")).over(order)).where(F.col("_size") <= sample_bytes)
    out: dict[str, list[bytes]] = {}
    for row in sorted(found.select("lang", "n", "word").collect(), key=lambda r: (r["lang"], -r["n"], bytes(r["word"]))):
        out.setdefault(row["lang"], []).append(bytes(row["word"]))
    return out


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def train(docs: DataFrame) -> Model:
    """Fitted on all documents with a language that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return _model(frequent_words(known))


_LETTER = regex.compile(r"\p{L}")


def _named(model: Model, text: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    rows, kinds = len(offsets) - 1, len(model.languages)
    cost, letters = np.zeros((kinds, rows)), np.zeros(rows)
    for a, b in doc_blocks(offsets):
        block = lowered(text[offsets[a] : offsets[b]])
        heads = offsets[a:b] - offsets[a]
        begin, end = letter_words(block, heads[heads < len(block)])
        owner = np.searchsorted(heads, begin, "right") - 1
        if (end - begin > LONG_WORD).any():
            number = -(-(end - begin) // LONG_WORD)
            spot = np.repeat(np.arange(len(begin)), number)
            first = begin[spot] + LONG_WORD * (np.arange(len(spot)) - np.repeat(np.cumsum(number) - number, number))
            begin, end, owner = first, np.minimum(first + LONG_WORD, end[spot]), owner[spot]
        if not len(begin):
            continue
        one, kind = distinct(block, begin, end)
        count = model.phrases(block, begin[one], end[one])
        letters[a:b] = np.bincount(owner, end - begin, b - a)
        for k in range(kinds):
            cost[k, a:b] = np.bincount(owner, count[k][kind], b - a)
    cost *= model.weight[:, None]
    names, scores = ["und"] * rows, np.zeros(rows)
    for i in np.flatnonzero(letters > 0) if kinds else ():
        if not _LETTER.search(text[offsets[i] : offsets[i + 1]].tobytes().decode()):
            continue
        order = np.argsort(cost[:, i], kind="stable")
        names[i] = model.languages[order[0]]
        second = cost[order[1], i] if kinds > 1 else letters[i] * model.weight[0]
        scores[i] = min(1.0, max(0.0, 1 - cost[order[0], i] / second)) if second else 0.0
    return names, scores


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): the language of every whole text.

    ``und`` with score 0 where the text is null or has no letter, or where there was
    nothing to learn from.  The score is the lead over the second language, 0 to 1.
    Ties go to the first language by name.  Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch) -> dict:
        names, scores = _named(shared.value, *utf8(batch.column(1)))
        return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": names, "score": scores}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return mapped(rows, step, "doc_id long, held_out boolean, lang_pred string, score double")


def named(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` with all its columns and the language of each text in ``column``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return extended(docs, "text", lambda texts: {column: pa.array(_named(shared.value, *utf8(texts))[0])}, f"`{column}` string")
