"""Token counts by a linear longest-match automaton.

Greedy longest-match word pieces (the first piece of a word from the word-initial vocabulary, later ones from the
continuing vocabulary) are counted in one pass over a word: a trie of the vocabulary has failure links, and each link
knows how many pieces it pops. No piece is built and no character is read twice.

A word is a run of characters other than white space. A word that the vocabulary can't cover counts as one token, as
unknown.

Defined cases: a null or empty text has no words and no tokens; very long words take one linear pass; repeated rows and
ties give equal counts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Fixed mark of word-initial pieces in vocabularies of the "piece" kind.
WORD_MARK = "▁"


class LongestMatch:
    """The automaton. State 0 is the start of a word, state 1 the start of a continuing piece."""

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                if not piece:
                    continue
                at = root
                for c in piece:
                    nxt = self.edges[at].get(c)
                    if nxt is None:
                        nxt = self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        ends.append(False)
                    at = nxt
                ends[at] = True
        # fail[v]: where matching goes on once v's string can't be extended; -1: nowhere. pops[v]: pieces taken on that way.
        self.fail = [-1] * len(self.edges)
        self.pops = [0] * len(self.edges)
        self.ends = ends
        queue = deque((0, 1))
        while queue:
            v = queue.popleft()
            for c, child in self.edges[v].items():
                queue.append(child)
                if ends[child]:
                    self.fail[child], self.pops[child] = 1, 1
                    continue
                z, popped = self.fail[v], self.pops[v]
                while z != -1 and c not in self.edges[z]:
                    popped += self.pops[z]
                    z = self.fail[z]
                if z != -1:
                    self.fail[child], self.pops[child] = self.edges[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the word; -1 if it can't be covered."""
        edges, fail, pops = self.edges, self.fail, self.pops
        at, n = 0, 0
        for c in word:
            while (nxt := edges[at].get(c)) is None:
                n += pops[at]
                at = fail[at]
                if at == -1:
                    return -1
            at = nxt
        while at != 1:
            if at == 0:
                return 0 if not word else -1
            n += pops[at]
            at = fail[at]
            if at == -1:
                return -1
        return n


def piece_vocabulary(model_path: str) -> tuple[list[str], list[str]]:
    """Word-initial and continuing pieces of a sentencepiece vocabulary file; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    initial, continuing = [], []
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i)
        (initial if piece.startswith(WORD_MARK) else continuing).append(piece.removeprefix(WORD_MARK))
    return initial, continuing


def count_tokens(docs: DataFrame, vocabulary: tuple[list[str], list[str]], id_col: str = "doc_id", text_col: str = "text", room: int = 300_000) -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for each row. ``vocabulary`` goes to the tasks: its size doesn't depend on the input.

    Counts of words seen before are kept, ``room`` of them in a task at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        count = LongestMatch(*shared.value).count

        class Kept(dict):
            def __missing__(self, word):
                if len(self) >= room:
                    self.clear()
                n = count(word)
                if len(word) <= 64:
                    self[word] = n
                return n

        kept = Kept()

        def step(rows):
            words = [(t or "").split() for t in rows["text"]]
            n = [[kept[w] for w in own] for own in words]
            lost = [own.count(-1) for own in n]
            return {"id": rows["id"], "n_words": [len(w) for w in words], "n_tokens": [sum(own) + 2 * u for own, u in zip(n, lost, strict=True)], "n_unknown": lost}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, n_words long, n_tokens long, n_unknown long").withColumnRenamed("id", id_col)
