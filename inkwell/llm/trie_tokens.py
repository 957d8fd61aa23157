"""Token counts under a unigram model, by dynamic programming over a trie.

The distinct pre-tokens (words behind a space mark) of a batch are sorted, which walks their trie depth first: a word keeps
the forward scores of the prefix that it shares with its predecessor and computes only the rest, and the end of each word
stores its count. Each text then adds up the counts of its words.

The pieces are those of a public vocabulary file; a piece of rank r costs ln(r + 2), in rounded thousandths, so that sums
are exact. Characters outside the vocabulary become bytes that cost as much as the rarest piece. The cheapest segmentation
counts; of equal ones that with fewer tokens. Null and empty texts have no tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import WORD, slices, table
from inkwell.llm.piece_bpe import MARK, default_model, model

FIND = regex.compile(WORD).findall
#: Distinct pre-tokens that a worker remembers before it starts anew.
MEMORY = 500_000


class Unigram:
    """Costs of pieces, and the tails by which longer pieces can still end."""

    def __init__(self, path: str):
        m = model(path)
        self.cost = {p: round(1000 * math.log(int(m.order[i]) + 2)) for p, i in m.ids.items()}
        self.byte_cost = round(1000 * math.log(len(self.cost) + 2))
        self.tails = {p[k:] for p in self.cost for k in range(len(p))}

    def counts(self, cuts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens and cost of each of the sorted pre-tokens."""
        cost_of, tails, byte_cost = self.cost.get, self.tails, self.byte_cost
        score, count = [0], [0]
        tokens, costs = [], []
        last = ""
        for word in cuts:
            shared = len(commonprefix((last, word)))
            del score[shared + 1 :], count[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best = fewest = -1
                for begin in range(end - 1, -1, -1):
                    piece = word[begin:end]
                    if piece not in tails:
                        break
                    c = cost_of(piece)
                    if c is not None:
                        c += score[begin]
                        n = count[begin] + 1
                        if best < 0 or c < best or c == best and n < fewest:
                            best, fewest = c, n
                if best < 0 or word[end - 1] not in self.cost:
                    raw = len(word[end - 1].encode())
                    c, n = score[end - 1] + raw * byte_cost, count[end - 1] + raw
                    if best < 0 or c < best or c == best and n < fewest:
                        best, fewest = c, n
                score.append(best)
                count.append(fewest)
            tokens.append(count[-1])
            costs.append(score[-1])
            last = word
        return tokens, costs


_MODELS: dict[str, Unigram] = {}


def unigram(path: str) -> Unigram:
    if path not in _MODELS:
        _MODELS[path] = Unigram(path)
    return _MODELS[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and cost (in thousandths) of every row of docs; other columns are left alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = unigram(path)
        known: dict[str, int] = {}
        tokens = costs = np.zeros(0, np.int64)
        for batch in slices(batches, "text"):
            if len(known) > MEMORY:
                known, tokens, costs = {}, np.zeros(0, np.int64), np.zeros(0, np.int64)
            found = [FIND(x) for x in batch.column(1).to_pylist()]
            fresh = sorted({w for ws in found for w in ws if w not in known})
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            t, c = m.counts([MARK + w for w in fresh])
            tokens, costs = np.r_[tokens, np.array(t, np.int64)], np.r_[costs, np.array(c, np.int64)]
            size = np.array([len(ws) for ws in found])
            codes = np.fromiter((known[w] for ws in found for w in ws), np.int64, int(size.sum()))
            ends = np.cumsum(size)
            total = [np.diff(np.r_[0, np.r_[0, np.cumsum(x[codes])][ends]]) for x in (tokens, costs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (size, *total))], names=["doc_id", "n_words", "n_tokens", "cost"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long, cost long")


def op6_trie_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_model())
