"""Spelling variants: words one edit apart, found with forward and backward minimal automata.

A word's edit lies in its first or its second half, so a near word either begins with the first half or ends with the
second. Words are dealt by the halves they could be asked for. A task builds one minimal acyclic automaton of its words
and one of them reversed; each arc carries how many words sort before it, so a path adds up to its word's number. A search
follows one half exactly and completes the other with one error. A pair that both directions find is kept by the first.
Halves that very many words share are divided once more: the error is then in one of two quarters, and three are exact.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, give_back, materialize, partitions, release, ship, sliced, table, texts

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SPOIL = 199  # one in so many (document, word) pairs loses a letter
LETTERS = 6  # fewest code points of a word
OCCURRENCES = 5  # fewest occurrences of a word
RATIO = 5  # a form occurs so many times as often as its variant, at least
TASK_WORDS = 50_000  # rows (word, half) of a task
HOT = 100_000  # a half that more words share is divided once more
HELD = 300_000  # distinct words counted in a task before they are sent on


def spoilt(doc_id: int | None, run: str) -> str:
    """The run, without one of its letters for one in ``SPOIL`` pairs of document and run; a null doc_id spoils none."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % SPOIL else run[: h % len(run)] + run[h % len(run) + 1 :]


def count_words(docs: DataFrame, least: int = OCCURRENCES, letters: int = LETTERS) -> DataFrame:
    """word and n of each distinct word of ``letters`` code points with ``least`` occurrences in the whole texts of ``docs``.

    A word is a run of Latin letters in which only A-Z are lower-cased. Null and empty texts have none. Repeated rows count
    as often as they occur.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                for word, n in Counter(RUN.findall(text.lower().decode())).items():
                    if len(word) >= letters:
                        word = spoilt(doc_id, word)
                        if len(word) >= letters:
                            held[word] += n
            if len(held) > HELD:
                yield table(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))
                held.clear()
        yield table(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

    found = doc_rows(docs, "doc_id", "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with perfect-hash numbers.

    ``arcs[s]`` maps a letter to the next state and to how many words of ``s`` sort before that arc, so the sum along a
    word's path is its place among the words.
    """

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._sizes: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], list[bool]]] = [({}, [False])]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                arcs, final = path.pop()
                path[-1][0][last[len(path) - 1]] = self._state(arcs, final[0], known)

        for word in words:
            same = 0
            for a, b in zip(last, word):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend(({}, [False]) for _ in range(len(word) - same))
            path[-1][1][0] = True
            last = word
        close(0)
        self.root = self._state(path[0][0], path[0][1][0], known)

    def _state(self, arcs: dict[str, int], final: bool, known: dict[tuple, int]) -> int:
        key = (final, *arcs.items())
        state = known.get(key)
        if state is None:
            state, size, numbered = len(self.arcs), int(final), {}
            for letter, to in arcs.items():
                numbered[letter] = (to, size)
                size += self._sizes[to]
            self.arcs.append(numbered)
            self.final.append(final)
            self._sizes.append(size)
            known[key] = state
        return state

    def walk(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that ``word[at:]`` completes from ``state``, or -1."""
        arcs = self.arcs
        for letter in word[at:]:
            step = arcs[state].get(letter)
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that agree with the first ``exact`` letters and differ by one edit behind them."""
        arcs, walk, state, number, found = self.arcs, self.walk, self.root, 0, set()
        for letter in word[:exact]:
            step = arcs[state].get(letter)
            if step is None:
                return found
            state, number = step[0], number + step[1]
        at, end = exact, len(word)
        while True:
            own = word[at] if at < end else None
            for letter, (to, before) in arcs[state].items():
                found.add(walk(to, number + before, word, at))
                if own is not None and letter != own:
                    found.add(walk(to, number + before, word, at + 1))
            if own is None:
                break
            found.add(walk(state, number, word, at + 1))
            step = arcs[state].get(own)
            if step is None:
                break
            state, number, at = step[0], number + step[1], at + 1
        found.discard(-1)
        return found


#: How a kind of search divides a query of m letters, h = m div 2 of them in its first half: letters exact at its begin
#: and at its end, and whether it goes backward. Kinds 0 and 1 are the halves; the others divide a hot half again.
KINDS = (
    lambda m, h: (h, 0, False),
    lambda m, h: (0, m - h, True),
    lambda m, h: (h + (m - h) // 2, 0, False),
    lambda m, h: (h, m - h - (m - h) // 2, True),
    lambda m, h: (0, m - h // 2, True),
    lambda m, h: (h // 2, m - h, False),
)
#: The same letters as SQL over m.
ENDS = (
    ("m div 2", "0"),
    ("0", "m - m div 2"),
    ("m div 2 + (m - m div 2) div 2", "0"),
    ("m div 2", "m - m div 2 - (m - m div 2) div 2"),
    ("0", "m - m div 4"),
    ("m div 4", "m - m div 2"),
)
#: Lengths of the queries that a word may answer.
LENGTHS = ("length(word)", f"greatest(length(word) - 1, {LETTERS})", "length(word) + 1")


def search(kind: int, word: str, forward: Automaton, backward: Automaton, words: list[str], reverse: list[str]) -> list[str]:
    """The near words that this kind of search answers for; kinds of one split never answer for the same pair."""
    m, h = len(word), len(word) // 2
    begin, end, back = KINDS[kind](m, h)
    if back:
        found = [reverse[i] for i in backward.near(word[::-1], end)]
    else:
        found = [words[i] for i in forward.near(word, begin)]
    if kind in (1, 4, 5):  # the first half is the forward search's
        found = [x for x in found if not x.startswith(word[:h])]
    if kind == 3:
        first = h + (m - h) // 2
        found = [x for x in found if x.startswith(word[:h]) and not x.startswith(word[:first])]
    if kind == 5:
        found = [x for x in found if x.endswith(word[h:]) and not x.endswith(word[h // 2 :])]
    return found


def _key(kind: int, m: str) -> str:
    """SQL of a word's key for queries of ``m`` letters: what must agree at its begin and at its end."""
    begin, end = (x.replace("m", f"({m})") if "m" in x else x for x in (e.replace("div", "DIV") for e in ENDS[kind]))
    return f"concat('{kind}:', left(word, int({begin})), ' ', right(word, int({end})))"


def _dealt(words: DataFrame, kind: int) -> DataFrame:
    """word, n, kind, key and query: once for each key under which a query one edit away may ask for it."""
    keys = F.expr(f"array_distinct(array({', '.join(_key(kind, m) for m in LENGTHS)}))")
    out = words.select("word", "n", F.lit(kind).alias("kind"), F.explode(keys).alias("key"))
    return out.withColumn("query", F.expr(f"key = {_key(kind, 'length(word)')}"))


def _divided(hot: DataFrame, half: int, kind: int) -> DataFrame:
    """Rows of a hot half under the keys of one of its quarters."""
    options = ", ".join(f"if(key = {_key(half, m)}, {_key(kind, m)}, null)" for m in LENGTHS)
    rows = hot.where(F.col("kind") == half).withColumn("sub", F.explode(F.expr(f"array_distinct(filter(array({options}), x -> x IS NOT NULL))")))
    asked = F.col("query") & (F.col("sub") == F.expr(_key(kind, "length(word)")))
    return rows.select("word", "n", F.lit(kind).alias("kind"), F.col("sub").alias("key"), asked.alias("query"))


def _searched(words: DataFrame, hot: int) -> DataFrame:
    """Rows (word, n, kind, key, query) of all searches, hot halves divided."""
    halves = _dealt(words, 0).unionByName(_dealt(words, 1))
    many = materialize(halves.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select(F.col("key").alias("hot")))
    count = many.count()
    if not count:
        return halves
    marked = halves.join(F.broadcast(many) if count <= 10_000 else many, F.col("key") == F.col("hot"), "left")
    busy = marked.where("hot IS NOT NULL").drop("hot")
    rest = marked.where("hot IS NULL").drop("hot")
    for half, kind in ((0, 2), (0, 3), (1, 4), (1, 5)):
        rest = rest.unionByName(_divided(busy, half, kind))
    return rest


def _task(pairs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).select(["word", "n", "kind", "query"]).to_pydict()
        n_of = dict(zip(rows["word"], rows["n"]))
        ways = [KINDS[k](8, 4)[2] for k in range(len(KINDS))]
        words = sorted({w for w, k in zip(rows["word"], rows["kind"]) if not ways[k]})
        turned = sorted({w[::-1] for w, k in zip(rows["word"], rows["kind"]) if ways[k]})
        forward, backward, reverse = Automaton(words), Automaton(turned), [w[::-1] for w in turned]
        out: list[tuple] = []
        for word, kind, query in zip(rows["word"], rows["kind"], rows["query"]):
            if not query:
                continue
            found = search(kind, word, forward, backward, words, reverse)
            if pairs:
                out += [(word, n_of[word], x, n_of[x]) for x in found]
            else:
                best = min(((-n_of[x], x) for x in found), default=(None, None))
                out.append((word, n_of[word], len(found), best[1], None if best[0] is None else -best[0]))
            if len(out) >= 20_000:
                yield _batch(out, pairs)
                out = []
        yield _batch(out, pairs)
        give_back()

    return run


def _batch(out: list[tuple], pairs: bool) -> pa.RecordBatch:
    names = ("word", "n", "near", "near_n") if pairs else ("word", "n", "n_near", "form", "form_n")
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64()) if pairs else (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*out)) if out else [()] * len(names)
    return table(**{n: pa.array(c, t) for n, c, t in zip(names, columns, kinds)})


def _run(words: DataFrame, pairs: bool, schema: str, hot: int) -> DataFrame:
    spark = words.sparkSession
    ship(spark)
    rows = _searched(words, hot)
    parts = max(partitions(spark), 4 * words.count() // TASK_WORDS)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition(parts, "part")
    return dealt.groupBy("part").applyInArrow(_task(pairs), schema)


def near_pairs(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(word, n, near, near_n) for all ordered pairs of distinct words (word, n) that are one edit apart.

    Words have ``LETTERS`` code points or more; of a table that repeats a word any of its n is taken.
    """
    return _run(words, True, "word string, n long, near string, near_n long", hot)


def nearest(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, n, n_near, and form and form_n: the near word of largest n, of several the first in code-point order."""
    found = _run(words, False, "word string, n long, n_near long, form string, form_n long", hot)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("m"), "form"))).alias("best")
    out = found.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), best)
    return out.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with root, where following forms ends. Each form is more frequent than its word, so
    chains are short: their known part doubles with each round, until no root has a form."""
    steps = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = steps.select(F.col("word").alias("w"), F.col("root").alias("r"))
        longer = materialize(steps.join(on, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")))
        release(steps)
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    ends = longer.select(F.col("word").alias("w"), "root")
    return forms.join(ends, F.col("word") == F.col("w"), "left").withColumn("root", F.coalesce("root", "word")).drop("w")


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``count_words``; form is null unless it is ``ratio`` times as frequent."""
    words = materialize(count_words(docs))
    found = nearest(words)
    clear = F.col("form_n") >= F.col("n") * ratio
    found = materialize(found.select("word", "n", "n_near", F.when(clear, F.col("form")).alias("form"), F.when(clear, F.col("form_n")).alias("form_n")))
    release(words)
    return roots(found).select("word", "form", "root", "n", "n_near", "form_n")
