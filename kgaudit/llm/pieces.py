"""SentencePiece encoding and decoding of whole texts with a merge-type prefix table.

A byte-pair model merges the adjacent pair whose joined piece scores best, the leftmost of equal ones, until no pair
joins to a piece. Tokens in a row are the encoding of a text just if every two neighbours are compatible, that is, if
merging their joined text gives these two again: merges are chosen by a total order, so the first merge across a
border would also happen in the pair alone. So every prefix of a text has one last token: the one that ends there and
is compatible with the last token of the prefix before it. An Aho-Corasick automaton lists the pieces that end at each
place, the table keeps the one that fits, and the ids are read from the table backwards. A text takes time in
proportion to its length, whatever its words are.

Where no piece has a space mark behind another character, or letters beside others, no merge crosses such a place, and
the table is made for each stretch between such places on its own; the pieces of the model tell which places these are.
The ids of short stretches are kept for the task, up to a number of them.

Only the model's bytes, half a megabyte here, go to the executors. Texts are not shuffled.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; characters that no piece
has become their UTF-8 bytes; texts of control pieces are ordinary text; a mark U+2581 in a text counts as a space and
decodes to one; rows without a doc_id and repeated rows are encoded like any others; extra columns are ignored; an empty
table gives an empty result. Models that aren't byte-pair models with byte fallback, or that have pieces that users
defined or that are unused, are refused.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.common import table, text_bytes

MARK = "▁"
#: Parameters: stretches of up to so many characters are kept, up to so many; so are results of so many pair tests.
KEPT_LENGTH, KEPT_STRETCHES, KEPT_PAIRS = 40, 300_000, 1_000_000
#: A batch of results goes out at about so many ids.
BATCH_IDS = 1_000_000
NONE = -1


def read_model(path: str) -> bytes:
    """The bytes of a model file on the driver, refused if the method doesn't hold for it."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as file:
        data = file.read()
    model = proto.ModelProto()
    model.ParseFromString(data)
    kinds = {piece.type for piece in model.pieces}
    kind = proto.ModelProto.SentencePiece
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or kind.BYTE not in kinds or kinds & {kind.USER_DEFINED, kind.UNUSED}:
        raise ValueError("a byte-pair model with byte fallback is needed, without unused pieces and pieces defined by users")
    return data


class PrefixTable:
    """Encodes texts with a model; keeps what it learned of stretches and pairs."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, size = self.library, self.library.get_piece_size()
        special = lambda i: lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)
        self.text = [None if special(i) else lib.id_to_piece(i) for i in range(size)]
        self.score = {t: lib.get_score(i) for i, t in enumerate(self.text) if t is not None}
        self.length = [len(t or "") for t in self.text]
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.text):
            if t is not None:
                self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.stretches = re.compile(self.borders()).findall
        self.pairs: dict[int, bool] = {}  # by the number of both tokens
        self.kept: dict[str, tuple[int, ...]] = {}

    def borders(self) -> str:
        """A pattern of stretches between which no piece reaches: the finest that this model's pieces allow."""
        inside = {pair for t in self.score for pair in zip(t, t[1:])}
        if any(b == MARK != a for a, b in inside):
            return "(?s:.+)"
        letters = re.escape("".join(sorted({c for t in self.score for c in t if c.isalpha()})))
        if not letters or any(a.isalpha() != b.isalpha() for a, b in inside if a != MARK):
            return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return f"{MARK}*(?:[{letters}]+|[^{letters}{MARK}]+)|{MARK}+"

    def merged(self, text: str) -> list[str]:
        """The parts that merging leaves of a short text."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, before: int, token: int) -> bool:
        """Whether a token may follow another one; it must stand by itself where nothing or an unknown character is before it."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        wanted = [self.text[token]] if before == NONE else [self.text[before], self.text[token]]
        found = self.pairs[before * len(self.text) + token] = self.merged("".join(wanted)) == wanted
        return found

    def last_tokens(self, text: str) -> list[int]:
        """For each prefix of a text, its last token; none at 0, and where the last character is in no piece."""
        last = [NONE] * (len(text) + 1)
        length, size, known = self.length, len(self.text), self.pairs.get
        for end, token in self.automaton.iter(text):
            end += 1
            if last[end] == NONE:
                before = last[end - length[token]]
                fits = known(before * size + token)
                if self.fits(before, token) if fits is None else fits:
                    last[end] = token
        return last

    def stretch(self, text: str) -> tuple[int, ...]:
        """The ids of one stretch, read from its table backwards."""
        last, ids, at = self.last_tokens(text), [], len(text)
        while at:
            if (token := last[at]) == NONE:
                at -= 1
                ids.extend(self.bytes[b] for b in reversed(text[at].encode()))
            else:
                ids.append(token)
                at -= self.length[token]
        return tuple(reversed(ids))

    def encode(self, text: str) -> list[int]:
        """The ids of a text, without those of begin and end."""
        kept, found = self.kept, []
        for part in self.stretches(self.library.normalize(text)):
            if (ids := kept.get(part)) is None:
                ids = self.stretch(part)
                if len(part) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_STRETCHES:
                        kept.clear()
                    kept[part] = ids
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        return self.library.decode(ids)


def encoded(docs: DataFrame, model: bytes) -> DataFrame:
    """``(doc_id, ids array<int>, decoded)`` of every row: its text's ids, and their text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = PrefixTable(model)
        for batch in it:
            numbers, ids, decoded, held = [], [], [], 0
            for number, text in zip(batch["doc_id"], text_bytes(batch["text"]), strict=True):
                found = made.encode(text.decode())
                numbers.append(number.as_py())
                ids.append(array("i", found))
                decoded.append(made.decode(found))
                held += len(found)
                if held >= BATCH_IDS:
                    yield as_batch(numbers, ids, decoded)
                    numbers, ids, decoded, held = [], [], [], 0
            yield as_batch(numbers, ids, decoded)

    def as_batch(numbers: list, ids: list[array], decoded: list[str]) -> pa.RecordBatch:
        ends = [0]
        for x in ids:
            ends.append(ends[-1] + len(x))
        flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(x.tobytes() for x in ids))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), lists, pa.array(decoded, pa.string())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, "doc_id long, ids array<int>, decoded string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encoded(table(spark, sf_dir, "documents"), read_model(model_path))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
