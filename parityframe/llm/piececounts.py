"""Token counts (operator 4): greedy word-piece lengths in linear time.

Counts the word pieces of each text (longest match first, from the left)
without building them. The vocabulary is a trie with two roots, one for
pieces that begin a word and one for pieces inside it. Every node has a
failure link, and how many pieces are done when it is followed; both are
computed once, breadth first. A word is then read once, character by
character, however long it is.

Words are runs of letters, digits and underscores; any other character that
is not white space is a word of its own. A word that the vocabulary cannot
spell counts as one unknown piece. The vocabulary comes from a SentencePiece
file: pieces marked with its word sign begin words, the others continue them;
control and byte pieces are left out. Case is kept.

The piece list goes to the tasks by broadcast and is refused beyond
``MAX_PIECES`` entries. Each worker remembers the counts of up to
``MEMO_WORDS`` words, since words repeat.

Defined results: null and empty texts have no words and no pieces; a long
text is read in parts cut at white space; other columns pass through, columns
of the input named like the added ones are replaced.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from parityframe.llm.common import read_table, ship

MAX_PIECES = 1 << 20
MEMO_WORDS = 300_000
PART_CHARS = 1 << 20
#: The sign that marks word beginnings in SentencePiece files (U+2581).
WORD_SIGN = chr(0x2581)
_WORDS = re.compile(r"\w+|[^\w\s]")
_SPACE = re.compile(r"\s")
#: In the memo, unknown words count one piece and one unknown.
UNKNOWN = -1


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin words, pieces inside words) of a SentencePiece file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{path} holds more than {MAX_PIECES} pieces")
    begin, inside = [], []
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i):
            continue
        piece = sp.id_to_piece(i)
        (begin if piece.startswith(WORD_SIGN) else inside).append(piece.removeprefix(WORD_SIGN))
    return [p for p in begin if p], [p for p in inside if p]


class PieceAutomaton(dict):
    """A dict of word -> number of pieces (UNKNOWN if it can't be spelled)."""

    BEGIN, INSIDE = 0, 1

    def __init__(self, begin: list[str], inside: list[str]):
        super().__init__()
        self.next: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, pieces in ((self.BEGIN, begin), (self.INSIDE, inside)):
            for piece in pieces:
                node = root
                for c in piece:
                    child = self.next[node].get(c)
                    if child is None:
                        child = self.next[node][c] = len(self.next)
                        self.next.append({})
                        whole.append(False)
                    node = child
                whole[node] = True
        n = len(self.next)
        self.fail: list[int | None] = [None] * n
        self.popped = [0] * n
        queue = deque([self.BEGIN, self.INSIDE])
        while queue:
            parent = queue.popleft()
            for c, node in self.next[parent].items():
                queue.append(node)
                if whole[node]:
                    # The whole path is the longest match: pop it, go on inside.
                    self.fail[node], self.popped[node] = self.INSIDE, 1
                    continue
                link, popped = self.fail[parent], self.popped[parent]
                while link is not None and c not in self.next[link]:
                    popped += self.popped[link]
                    link = self.fail[link]
                if link is not None:
                    self.fail[node], self.popped[node] = self.next[link][c], popped

    def count(self, word: str) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        node, pieces = self.BEGIN, 0
        for c in word:
            child = step[node].get(c)
            while child is None:
                pieces += popped[node]
                node = fail[node]
                if node is None:
                    return UNKNOWN
                child = step[node].get(c)
            node = child
        while node != self.INSIDE:
            pieces += popped[node]
            node = fail[node]
            if node is None:
                return UNKNOWN
        return pieces

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = n
        return n


def text_parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text in parts that end where white space begins."""
    at = 0
    while len(text) - at > size:
        cut = _SPACE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_AUTOMATA: dict[int, PieceAutomaton] = {}


def count_pieces(docs: DataFrame, piece_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, n_tokens and n_unknown of each text."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("n_words", "n_tokens", "n_unknown")
    pieces = spark.sparkContext.broadcast(read_pieces(piece_path))
    added = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, inside = pieces.value
        key = hash((tuple(begin), tuple(inside)))
        if key not in _AUTOMATA:
            _AUTOMATA[key] = PieceAutomaton(begin, inside)
        counts = _AUTOMATA[key].__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(text_col):
                words = pieces_ = unknown = 0
                for part in text_parts(text.as_py() or ""):
                    found = list(map(counts, _WORDS.findall(part)))
                    bad = found.count(UNKNOWN)
                    words += len(found)
                    unknown += bad
                    pieces_ += sum(found) + 2 * bad  # an unknown word is -1 in the sum, and one piece
                rows.append((words, pieces_, unknown))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.record_batch([*batch.columns, *columns], names=schema.names)
    return docs.mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_pieces(docs, public_tokenizers.path("piece_bpe_32k.model")).select(
        "doc_id", "n_words", "n_tokens", "n_unknown")
