"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text finds, from any place of a text, the longest match in that
language's sample; a text is parsed into such matches (phrases) one after the other. The phrases that a language
needs, times the bits that point into its sample, for each character, estimate its cross entropy: the lowest wins.

The samples are bounded by parameters: of each of the `languages` that have the most labelled documents (ties: those that sort first), whole texts of up to
`sample_docs` labelled documents, with `sample_chars` characters together (one text at least), those with the smallest hashes of their ids; texts of
more than an eighth of that come last. Only ids and hashes are ranked, first within salted parts of a language; the texts of those chosen are
fetched by a join. Whole texts are parsed, in lower case.

The score is the share of characters that the best language's phrases save: 1 - phrases / characters.
A text that is null or has no letter gets `und` and score 0; so does every text where no language was learned.
Ties go to the language that sorts first. Rows without lang only get predictions. Repeated rows each give a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slices

BLOCK = 1000
_NOWHERE: dict = {}
_READY: dict[int, list] = {}


def suffix_automaton(text: str) -> dict:
    """The start state; states are dictionaries from a character to the next state."""
    states, link, length = [{}], [-1], [0]
    last = 0
    for ch in text:
        cur = len(states)
        states.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in states[p]:
            states[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = states[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                copy = len(states)
                states.append(dict(states[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and states[p].get(ch) == q:
                    states[p][ch] = copy
                    p = link[p]
                link[q] = link[cur] = copy
        last = cur
    for state in states:
        for ch, to in state.items():
            state[ch] = states[to]
    return states[0]


def phrases(text: str, start: dict, most: float = math.inf) -> tuple[int, int]:
    """Greedy longest matches that cover the text, and the characters read; it ends early beyond `most` phrases.

    A character that the sample lacks is a phrase by itself.
    """
    count, state, get = 0, _NOWHERE, start.get
    for at in range(0, len(text), BLOCK):
        for ch in text[at : at + BLOCK]:
            state = state.get(ch)
            if state is None:
                count += 1
                state = get(ch, _NOWHERE)
        if count > most:
            return count, min(len(text), at + BLOCK)
    return count, len(text)


def rank(text: str, learned: list[tuple[str, dict, float]]) -> tuple[str, float]:
    """The language with the fewest bits for the text, and the share of its characters that its phrases save.

    The languages come in the order of the first block, and one is given up as soon as it needs more than the best
    so far, which decides nothing but the time it takes.
    """
    head = text[:BLOCK]
    order = sorted(learned, key=lambda x: (phrases(head, x[1])[0] * x[2], x[0])) if len(text) > BLOCK else learned
    best, name, needed = math.inf, "", 0
    for language, start, bits in order:
        count, read = phrases(text, start, best / bits * (1 + 1e-12))
        if read == len(text) and (count * bits, language) < (best, name or language + "~"):
            best, name, needed = count * bits, language, count
    return name, 1 - needed / len(text)


def learn(docs: DataFrame, usable: Column, sample_docs: int = 100, sample_chars: int = 48_000, languages: int = 200, salts: int = 64) -> dict[str, str]:
    """The sample text of each language, from rows for which `usable` holds."""
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size, text_hash = F.char_length("text").alias("size"), F.xxhash64("text").alias("text_hash")
    ids = known.select("lang", "doc_id", size, text_hash, (F.char_length("text") > sample_chars // 8).alias("is_long"), F.xxhash64("doc_id").alias("dealt"))
    order = ["is_long", "dealt", "doc_id", "text_hash"]
    salted = Window.partitionBy("lang", F.pmod("text_hash", F.lit(salts))).orderBy(*order)
    best = ids.withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= sample_docs)
    often = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).select("lang")
    by_lang = Window.partitionBy("lang").orderBy(*order)
    best = best.join(often, "lang", "left_semi").withColumn("n", F.row_number().over(by_lang)).filter(F.col("n") <= sample_docs)
    chosen = best.withColumn("total", F.sum("size").over(by_lang.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = chosen.filter((F.col("total") <= sample_chars) | (F.col("n") == 1)).select("lang", "n", F.col("doc_id").alias("id"), F.col("text_hash").alias("its_hash"))
    # at most languages * sample_docs rows, whose texts have sample_chars each language but for single longer ones
    fetched = known.join(F.broadcast(chosen.withColumnRenamed("lang", "its_lang")), F.col("doc_id").eqNullSafe(F.col("id")) & (text_hash == F.col("its_hash")) & (F.col("lang") == F.col("its_lang")))
    texts: dict[str, dict[int, str]] = {}
    for r in fetched.select("lang", "n", "text").dropDuplicates(["lang", "n"]).collect():
        texts.setdefault(r["lang"], {})[r["n"]] = r["text"].lower()
    joined = {k: " ".join(v[n] for n in sorted(v)) for k, v in sorted(texts.items())}
    return {k: v for k, v in joined.items() if any(c.isalpha() for c in v)}


def predict(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score of each row."""
    kind = dict(docs.dtypes)[id_col]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(samples.items()))
        if key not in _READY:
            _READY.clear()
            _READY[key] = [(k, suffix_automaton(v), math.log2(len(v) + 1)) for k, v in samples.items()]
        for batch in slices(batches):
            names, scores = [], []
            for text in batch.column(1):
                text = (text.as_py() or "").lower()
                if not _READY[key] or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                name, score = rank(text, _READY[key])
                names.append(name)
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(parse, f"`{id_col}` {kind}, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents whose crc32(id) mod 4 is not 2."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return predict(docs, learn(docs, ~held_out)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
