"""SentencePiece (merge type) encoding by a prefix table, and decoding.

A merge-type encoding is determined by local tests: a token sequence is the encoding of its
text exactly when each adjacent pair of tokens is the encoding of the pair's own text.  So
every prefix of a text has one last token.  Left to right, an automaton lists the vocabulary
entries that end at a position; the entry that is compatible with the last token of the prefix
before it is that prefix's last token.  The ids are then read backwards from the full prefix.

White space starts a token and is never inside one (checked when the model is read), so a text
splits into units "blanks + word"; the table is built per distinct unit and kept per worker, in
a bounded memory.  Entries made of blanks alone share one score, which breaks the uniqueness of
last tokens; a unit with two or more leading blanks is therefore merged directly, pair by pair.
A character outside the vocabulary becomes its UTF-8 byte tokens, which never merge.

Edge cases: a null text is empty; an empty text is the end id alone; repeated rows give
repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ersa.llm.common import id_text

BLANK = "▁"
_UNITS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Units, and token pairs, that a worker remembers before it starts afresh (memory bound only).
KEEP_UNITS, KEEP_PAIRS = 1_000_000, 1_000_000
KEEP_LENGTH = 64
#: Characters of units whose decoding differs from them, and of these decodings, that are kept from text to text.
KEEP_ODD_CHARS = 8_000_000

COLUMNS = {
    "n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string"),
    "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string"),
}


class Codec:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model_file: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or not model.trainer_spec.byte_fallback
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("this codec reads merge-type models with byte fallback and no text normalisation")
        self.lead = " " if norm.add_dummy_prefix else ""
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.piece: list[str] = []
        self.byte_of: dict[int, int] = {}
        self.silent: set[int] = set()
        self.unknown: set[int] = set()
        for i, p in enumerate(model.pieces):
            self.piece.append(p.piece.replace(BLANK, " "))
            if p.type == kinds.NORMAL:
                if BLANK in p.piece.lstrip(BLANK):
                    raise ValueError("a vocabulary entry has white space inside")
                self.rank[p.piece], self.id[p.piece] = -p.score, i
            elif p.type == kinds.BYTE:
                value = int(p.piece[3:5], 16)
                self.byte_id[value], self.byte_of[i] = i, value
            elif p.type == kinds.CONTROL:
                self.silent.add(i)
            elif p.type == kinds.UNKNOWN:
                self.unknown.add(i)
            else:
                raise ValueError("user-defined and unused vocabulary entries are not supported")
        self.end_id = next(i for i, p in enumerate(model.pieces) if p.piece == (model.trainer_spec.eos_piece or "</s>"))
        self.unknown_surface = model.trainer_spec.unk_surface
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if self.merge(piece) == [piece]:             # an entry that merges cannot reach is never used
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.odd_chars = 0
        self.per_token: dict[str, tuple[str, str]] = {}

    # ---- encoding -------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored adjacent pair, the leftmost of equals, until none is an entry."""
        parts = list(text)
        rank, never = self.rank.get, float("inf")
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], never)
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], never)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens are the encoding of their joined text (remembered)."""
        if len(self.pairs) >= KEEP_PAIRS:
            self.pairs.clear()
        fits = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return fits

    def tokens(self, unit: str) -> list[str]:
        """The unit's tokens by its prefix table (the last token of every prefix), read backwards."""
        if unit.startswith(BLANK + BLANK):
            return self.merge_run(unit)
        pairs = self.pairs
        last: list[str | None] = [None] * len(unit)
        for end, (piece, size) in self.automaton.iter(unit):
            if last[end] is None:
                if size <= end:                          # the last token of the prefix before this entry
                    before = last[end - size] or unit[end - size]
                    fits = pairs.get((before, piece))
                    if fits is None:
                        fits = self.compatible(before, piece)
                    if not fits:
                        continue
                last[end] = piece
        out, i = [], len(unit)
        while i:
            token = last[i - 1] or unit[i - 1]           # a character outside the vocabulary stands alone
            out.append(token)
            i -= len(token)
        return out[::-1]

    def merge_run(self, unit: str) -> list[str]:
        """A unit with several leading blanks: the blanks but the last, by direct merges with the word's start.

        Blank-only entries rank below all others, so the word's own part is settled first; it
        takes the last blank along or not, and what blanks remain are merged directly.
        """
        word = unit.lstrip(BLANK)
        blanks = len(unit) - len(word)
        tail = self.tokens(BLANK + word) if word else []
        if tail and tail[0] != BLANK:
            return self.merge_blanks(blanks - 1) + tail
        return self.merge_blanks(blanks) + tail[1:]

    def merge_blanks(self, n: int) -> list[str]:
        """``n`` blanks: equal scores join from the left, pass by pass, as the library's queue does."""
        from heapq import heapify, heappop, heappush

        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        queue = [(rank[BLANK * 2], i, i + 1, 2) for i in range(n - 1)] if BLANK * 2 in rank else []
        heapify(queue)
        while queue:
            _, i, j, total = heappop(queue)
            if not size[i] or j >= n or not size[j] or size[i] + size[j] != total or after[i] != j:
                continue
            size[i], size[j] = total, 0
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and BLANK * (size[a] + size[b]) in rank:
                    heappush(queue, (rank[BLANK * (size[a] + size[b])], a, b, size[a] + size[b]))
        return [BLANK * s for s in size if s]

    def token_ids(self, token: str) -> list[int]:
        i = self.id.get(token)
        return [self.byte_id[b] for b in token.encode()] if i is None else [i]

    def split(self, text: str) -> list[str]:
        """The text's units; a text that is not empty gets one leading blank if the model says so."""
        return _UNITS.findall((self.lead + text).replace(" ", BLANK)) if text else []

    def encode(self, text: str, add_end: bool = True) -> list[int]:
        ids = [i for unit in self.split(text)
               for token in self.tokens(unit) for i in self.token_ids(token)]
        return [*ids, self.end_id] if add_end else ids

    # ---- decoding -------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Entries joined, blanks as spaces, runs of byte tokens as UTF-8 (a bad byte as U+FFFD), control
        ids dropped; of a text's first entry, the blank that encoding put before it goes."""
        return self.without_lead(self.joined(ids), ids)

    def without_lead(self, text: str, ids: list[int]) -> str:
        first = next((i for i in ids if i not in self.silent), None)
        lead = self.lead and first is not None and first not in self.byte_of and first not in self.unknown
        return text[1:] if lead and text.startswith(" ") else text

    def joined(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i not in self.silent:
                out.append(self.unknown_surface if i in self.unknown else self.piece[i])
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    # ---- whole texts ----------------------------------------------------------------------

    def token_known(self, token: str) -> tuple[str, str]:
        """A token's decimal ids joined by spaces, and the decoding of those ids (remembered)."""
        ids = self.token_ids(token)
        known = self.per_token[token] = " ".join(map(str, ids)), self.joined(ids)
        return known

    def learn(self, unit: str) -> str:
        """A unit's decimal ids joined by spaces, remembered if short; its decoding too where it differs."""
        per_token = self.per_token
        known = [per_token.get(t) or self.token_known(t) for t in self.tokens(unit)]
        ids, decoded = " ".join([k[0] for k in known]), "".join([k[1] for k in known])
        if len(unit) <= KEEP_LENGTH:
            if len(self.units) >= KEEP_UNITS:
                self.units.clear()
            self.units[unit] = ids
        if decoded != unit.replace(BLANK, " "):
            if unit not in self.odd:
                self.odd_chars += len(unit) + len(decoded)
            self.odd[unit] = decoded
        return ids

    def row(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by spaces (with the end id), their number, and the decoded text."""
        if self.odd_chars > KEEP_ODD_CHARS:                # between texts only, and with the units, which are then learnt anew
            self.units.clear()
            self.odd.clear()
            self.odd_chars = 0
        units = self.split(text)
        try:
            parts = list(map(self.units.__getitem__, units))
        except KeyError:
            known = self.units
            parts = [known.get(unit) or self.learn(unit) for unit in units]
        parts.append(str(self.end_id))
        ids = " ".join(parts)
        if self.odd and not self.odd.keys().isdisjoint(units):
            whole = "".join([self.odd.get(u) or u.replace(BLANK, " ") for u in units])
        else:
            whole = "".join(units).replace(BLANK, " ")
        return ids, ids.count(" ") + 1, whole[1:] if self.lead and whole.startswith(" ") else whole


def _utf8(raw: bytes) -> str:
    """Bytes as text; every byte that starts no valid character is one U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i:i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None, columns: tuple[str, ...] = ("ids", "decoded"),
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen ``columns`` of every document: the ids (with the end id) and their
    decoding, or digests of them made where they arise, so that the ids need not leave the task.

    Maps over the scan: no shuffle, no state between rows but the workers' memory of units.
    """
    path = model_file or default_model()
    names = ["doc_id", *columns]
    schema = "doc_id long, " + ", ".join(f"{c} {COLUMNS[c][1]}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        make = {
            "n_tokens": lambda r: r[1],
            "ids_sha256": lambda r: hashlib.sha256(r[0].encode()).hexdigest(),
            "decoded_sha256": lambda r: hashlib.sha256(r[2].encode()).hexdigest(),
            "ids": lambda r: [int(i) for i in r[0].split(" ")],
            "decoded": lambda r: r[2],
        }
        for batch in batches:
            texts = batch.column(1)
            out: list[list] = [[] for _ in columns]
            for i in range(len(texts)):
                r = c.row(texts[i].as_py())
                for k, name in enumerate(columns):
                    out[k].append(make[name](r))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(v, COLUMNS[n][0]) for v, n in zip(out, columns))], names=names)

    return id_text(docs, id_col, text_col).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model_file: str | None = None, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """doc_id and ``decoded``, the text of each row's ids; null ids decode to an empty text."""
    path = model_file or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    from pyspark.sql import functions as F

    return encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids")) \
        .mapInArrow(run, "doc_id long, decoded string")
