"""Test passages that stand in a corpus, wholly or in part."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mistrail.llm.letters import joined, letters, spelled
from mistrail.llm.wu_manber import BLOCK, WuManber

#: Bytes of texts that a task searches at a time, and that it holds where there are several blocks of items.
TEXT_BYTES = 4_000_000
HELD_BYTES = 64_000_000
#: Letters of a block in the search for short stretches.
SHORT_BLOCK = 6
_WORD, _DIGITS = re.compile(rb"[\w\x80-\xff]*"), re.compile(rb"\d+")


@dataclass(frozen=True)
class LeakModel:
    """What counts as a leaked passage; the defaults are the production ones."""

    #: Successive words that make a passage, and least distance of two replaced words.
    least_words: int = 25
    apart: int = 8
    #: Letters of the search window, and of the one for stretches of ``apart - 1`` words that have fewer.
    window: int = 20
    short_window: int = 8
    #: Letters that must agree after a replaced word, and how far they are searched for (a longer word: at its end).
    resume: int = 10
    search: int = 48
    #: Bytes of passages whose tables a task holds at a time, and that one scan of the corpus searches for.
    block_bytes: int = 8_000_000
    scan_bytes: int = 64_000_000


class _Text:
    """A document: its letters, and where its words end."""

    def __init__(self, letters: bytes, text: bytes):
        self.letters, self.text = letters, text

    @cached_property
    def spelled(self) -> tuple[bytes, np.ndarray]:
        """The plain text, and the position in it of each letter."""
        return spelled(self.text)

    def word_end(self, j: int) -> int:
        """Number of letters up to the end of the word that holds letter ``j``."""
        raw, place = self.spelled
        return int(np.searchsorted(place, _WORD.match(raw, place[j]).end())) if j < len(place) else len(place)

    def word_start(self, j: int) -> int:
        """Number of letters before the word that holds the letter before ``j``."""
        raw, place = self.spelled
        at = int(place[j - 1]) if j else 0
        while at and (raw[at - 1] >= 128 or raw[at - 1 : at].isalnum() or raw[at - 1] == 95):
            at -= 1
        return int(np.searchsorted(place, at))

    def numerals(self, j: int) -> list[bytes]:
        """The numerals that stand before letter ``j``, without leading zeros."""
        raw, place = self.spelled
        return [str(int(g)).encode() for g in _DIGITS.findall(raw, int(place[j - 1]) + 1, int(place[j]))]


class Passages:
    """The items as letters with the word of each letter, and every stretch of apart - 1 words as a pattern.

    Two replaced words of a passage are at least ``apart`` words apart, so ``apart - 1`` words between them are as in the
    item: a passage of ``least_words`` has such a stretch, and its occurrence in the corpus is where the passage is looked
    for. Stretches with fewer letters than the window make a search of their own with a shorter one; only those with fewer
    than ``short_window`` letters are lengthened.
    """

    def __init__(self, ids: list[int], texts: list[str], model: LeakModel):
        self.ids, self.model = np.array(ids, np.int64), model
        self.letters: list[bytes] = []
        #: Of each item, its numerals by the letter before which they stand: [(letter, [(word, digits)])].
        self.numerals: list[dict[int, list[tuple[int, bytes]]]] = []
        self.word: list[np.ndarray] = []
        self.word_start: list[np.ndarray] = []
        long: dict[bytes, list[tuple[int, int]]] = {}
        short: dict[bytes, list[tuple[int, int]]] = {}
        for number, text in enumerate(texts):
            tokens = re.findall(r"\w+", text)
            words = [letters(w.encode("utf-8", "ignore")) for w in tokens]
            size = np.array([len(w) for w in words], np.int64)
            begin = np.cumsum(size) - size
            whole = b"".join(words)
            self.letters.append(whole)
            self.word.append(np.repeat(np.arange(len(words)), size))
            self.word_start.append(np.append(begin, len(whole)))
            numerals: dict[int, list[tuple[int, bytes]]] = {}
            for k, token in enumerate(tokens):
                if not words[k] and token.isdecimal():
                    numerals.setdefault(int(begin[k]), []).append((k, str(int(token)).encode()))
            self.numerals.append(numerals)
            if len(words) < model.least_words:
                continue
            for k in range(len(words) - model.apart + 2):
                last = k + model.apart - 1
                while last < len(words) and begin[last] - begin[k] < model.short_window:
                    last += 1
                stop = begin[last] if last < len(words) else len(whole)
                if (n := stop - begin[k]) >= model.short_window:
                    (long if n >= model.window else short).setdefault(whole[begin[k] : stop], []).append((number, int(begin[k])))
        self.searches = []
        for where, window, block in ((long, model.window, BLOCK), (short, model.short_window, SHORT_BLOCK)):
            if where:
                count = np.array([len(places) for places in where.values()], np.int64)
                places = np.array([x for p in where.values() for x in p], np.int64)
                self.searches.append((WuManber(list(where), window, block), np.concatenate([[0], np.cumsum(count)]), places[:, 0], places[:, 1]))

    def _onward(self, doc: _Text, j: int, item: int, i: int) -> tuple[int, list[int], list[tuple[int, int, int]]]:
        """Going right from an agreement at (j, i): last word of the passage, replaced words, stretches (i, j, length) that agree."""
        own, word, start, m, text = self.letters[item], self.word[item], self.word_start[item], self.model, doc.letters
        replaced: list[int] = []
        agreed: list[tuple[int, int, int]] = []
        while i < len(own):
            n = min(len(own) - i, 64)
            a, b = own[i : i + n], text[j : j + n]
            if a == b:
                agreed.append((i, j, n))
                i, j = i + n, j + n
                continue
            n = next(k for k in range(n) if k >= len(b) or a[k] != b[k])
            agreed.append((i, j, n))
            i, j = i + n, j + n
            at = int(word[i])
            last = at - 1 if i else -1
            ahead = text[j : j + m.search + m.resume]
            # Letters put in before a word, as of a numeral: the word goes on after them.
            if i == start[at] and (k := ahead[: 2 + m.resume].find(own[i : i + m.resume])) > 0:
                j += k
                continue
            if replaced and at - replaced[-1] < m.apart:
                return last, replaced, agreed
            on = int(start[at + 1]) if at + 1 < len(start) else len(own)
            rest = own[on : on + m.resume]
            k = ahead.find(rest) if len(rest) == m.resume else -1
            if k < 0 and rest and text.find(rest, j) > j:
                # A word of any length, or the last words of the item: they go on where the replacing word ends.
                end = doc.word_end(j)
                k = end - j if text[end : end + len(rest)] == rest else -1
            if k < 0:
                return last, replaced, agreed
            replaced.append(at)
            i, j = on, j + k
        return int(word[-1]), replaced, agreed

    def _backward(self, doc: _Text, j: int, item: int, i: int) -> tuple[int, list[int], list[tuple[int, int, int]]]:
        """The same going left from the letters before (j, i), with the first word."""
        own, word, start, m, text = self.letters[item], self.word[item], self.word_start[item], self.model, doc.letters
        replaced: list[int] = []
        agreed: list[tuple[int, int, int]] = []
        while i > 0:
            n = min(i, j, 64)
            a, b = own[i - n : i], text[j - n : j]
            if n and a == b:
                agreed.append((i - n, j - n, n))
                i, j = i - n, j - n
                continue
            k = 0
            while k < n and a[n - 1 - k] == b[n - 1 - k]:
                k += 1
            i, j = i - k, j - k
            agreed.append((i, j, k))
            if not i:
                break
            at = int(word[i - 1])
            behind = text[max(0, j - m.search - m.resume) : j]
            close = behind[-2 - m.resume :]
            if i == start[at + 1] and i >= m.resume and (k := close.rfind(own[i - m.resume : i])) >= 0 and k + m.resume < len(close):
                j -= len(close) - k - m.resume
                continue
            if replaced and replaced[-1] - at < m.apart:
                return at + 1, replaced, agreed
            on = int(start[at])
            rest = own[max(0, on - m.resume) : on]
            k = behind.rfind(rest) if len(rest) == m.resume else -1
            back = len(behind) - k - m.resume if k >= 0 else -1
            if back < 0 and rest and text.rfind(rest, 0, j) >= 0:
                begin = doc.word_start(j)
                back = j - begin if text[max(0, begin - len(rest)) : begin] == rest else -1
            if back < 0:
                return at + 1, replaced, agreed
            replaced.append(at)
            i, j = on, j - back
        return 0, replaced, agreed

    def _longest(self, first: int, last: int, replaced: list[int]) -> int:
        """Words of the longest stretch of first..last in which any two replaced words are ``apart`` words apart."""
        clashes = [(a, b) for a, b in zip(replaced, replaced[1:]) if b - a < self.model.apart]
        starts = [first, *(a + 1 for a, _ in clashes)]
        ends = [*(b - 1 for _, b in clashes), last]
        return max(b - a + 1 for a, b in zip(starts, ends))

    def passage(self, doc: _Text, j: int, item: int, i: int) -> tuple[int, list[tuple[int, int, int]]]:
        """Words of the passage of ``item`` through the agreement of the document from letter j and the item from letter i,
        and the stretches (i, j, length) that agree.

        A numeral of the item that doesn't stand at its place in the document is a replaced word; numerals that only stand
        in the document are added ones.
        """
        last, right, ahead = self._onward(doc, j, item, i)
        first, left, behind = self._backward(doc, j, item, i)
        words = self._longest(first, last, sorted([*left, *right]))
        if words < self.model.least_words or not self.numerals[item]:
            return words, [*ahead, *behind]
        changed = set()
        for a, b, n in [*ahead, *behind]:
            for letter, numerals in self.numerals[item].items():
                if a < letter < a + n:
                    given = doc.numerals(b + letter - a)
                    for word, digits in numerals:
                        if digits in given:
                            given = given[given.index(digits) + 1 :]
                        else:
                            changed.add(word)
        return self._longest(first, last, sorted({*left, *right, *changed})) if changed else words, [*ahead, *behind]

    def _hits(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position, item and letter of the item of every stretch that stands in ``whole``."""
        parts = []
        for search, first, items, places in self.searches:
            at, number = search.find(whole)
            size = first[number + 1] - first[number]
            nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            place = np.repeat(first[number], size) + nth
            parts.append((np.repeat(at, size), items[place], places[place]))
        return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3

    def find(self, texts: list[bytes | None]) -> list[tuple[int, int, int]]:
        """(text number, item number, words of the longest passage) for passages of at least ``least_words``."""
        whole, begins = joined(texts)
        position, item, inside = self._hits(whole)
        if not len(position):
            return []
        number = np.searchsorted(begins, position, "right") - 1
        # A hit within what an earlier attempt followed on its diagonal would give the same passage; any other is followed.
        order = np.lexsort((position, position - inside, item, number))
        best: dict[tuple[int, int], int] = {}
        followed: dict[int, list[tuple[int, int]]] = {}
        doc, base, key = _Text(b"", b""), -1, (-1, -1)
        for d, n, p, i in zip(number[order].tolist(), item[order].tolist(), position[order].tolist(), inside[order].tolist()):
            if d != base:
                base = d
                stop = begins[base + 1] - 1 if base + 1 < len(begins) else len(whole) - 1
                doc = _Text(whole[begins[base] : stop].tobytes(), texts[base])
            if key != (d, n):
                key, followed = (d, n), {}
            j = p - int(begins[d])
            if any(low <= j < high for low, high in followed.get(j - i, ())):
                continue
            words, agreed = self.passage(doc, j, n, i)
            best[key] = max(best.get(key, 0), words)
            for at, to, length in agreed:
                if length:
                    followed.setdefault(to - at, []).append((to, to + length))
        return [(d, i, n) for (d, i), n in best.items() if n >= self.model.least_words]


@lru_cache(2)
def _passages(ids: tuple[int, ...], texts: tuple[str, ...], model: LeakModel) -> Passages:
    """The tables of a block of items, made once per Python worker."""
    return Passages(list(ids), list(texts), model)


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, model: LeakModel = LeakModel()) -> DataFrame:
    """(doc_id, item_id, n_words): documents in which at least ``least_words`` successive words of an item stand.

    Case, punctuation, spacing, hyphens, line breaks, character forms, markup and added numerals don't matter, and single
    words (or numerals) may be replaced, by a word of any length, if they are ``apart`` words apart and ``resume`` letters
    (or the rest of the item) agree behind them. n_words is the length of the longest passage found, in words of the item. Letters of all scripts count, but for Latin ones with marks (see
    ``letters``).

    Method: Wu-Manber search for all stretches of apart - 1 words of the items at once. Blocks of letters index a shift
    table that skips impossible positions, the hash of a window selects the patterns of a bucket, and direct comparison
    confirms them; from there the passage is followed in both directions, over replaced words, and measured.

    The corpus is read once, whole texts, without a shuffle; the items are the query set. Their tables are made in the
    tasks, for ``block_bytes`` of items at a time; more than ``scan_bytes`` of items take a further scan each (the 200
    items of a test suite are one block).

    Defined results: null and empty texts contain nothing; items without text or with fewer than ``least_words`` words
    are never found; repeated documents and items count once; null ids stay null. A stretch of seven words with fewer than
    ``short_window`` letters (numerals mostly) is only searched for together with the words after it.
    """
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("item_text")).filter("length(item_text) > 0").distinct()
    size = wanted.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    scans = max(1, -(-size // model.scan_bytes))
    documents = corpus.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).filter("text IS NOT NULL")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_words", pa.int32())])

    def scan(rows: list) -> DataFrame:
        blocks, held = [], model.block_bytes
        for row in rows:
            if held >= model.block_bytes:
                blocks.append(([], []))
                held = 0
            blocks[-1][0].append(row[0])
            blocks[-1][1].append(row[1])
            held += len(row[1].encode("utf-8", "ignore"))
        blocks = [(tuple(ids), tuple(texts)) for ids, texts in blocks]

        def hits(numbers: list, bodies: list) -> Iterator[pa.RecordBatch]:
            # Texts are searched some megabytes at a time; one that is longer, alone.
            place = np.cumsum([len(b) for b in bodies]) // TEXT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(bodies)]
            for ids, texts in blocks:
                passages = _passages(ids, texts, model)
                for low, high in zip(edges, edges[1:]):
                    found = passages.find(bodies[low:high])
                    if found:
                        columns = [[numbers[low + d] for d, _, _ in found], [ids[i] for _, i, _ in found], [n for _, _, n in found]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, bodies, held = [], [], 0
            for batch in batches:
                numbers.extend(batch.column(0).to_pylist())
                bodies.extend(batch.column(1).to_pylist())
                held += batch.nbytes
                # With several blocks of items, as many texts wait as pay for making their tables.
                if held >= (HELD_BYTES if len(blocks) > 1 else TEXT_BYTES):
                    yield from hits(numbers, bodies)
                    numbers, bodies, held = [], [], 0
            if bodies:
                yield from hits(numbers, bodies)

        return documents.mapInArrow(search, "doc_id long, item_id long, n_words int")

    found = None
    for nth in range(scans):
        part = scan(wanted.filter(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(scans)) == nth).orderBy("item_id", "item_text").collect())
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("n_words"))
