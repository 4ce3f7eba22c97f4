"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the text once and keeps a window of as many places as the longest piece has characters. At each
place it knows the best last piece of the text up to there, with a pointer back to that piece's start; as soon as the
pointers of all places in the window lead through one boundary, the ids before it are final and are handed out.

The model at hand is a byte-pair model, whose result is not the path with the greatest sum of scores but the outcome of
merging the best pair first. That outcome is a path, too: a sequence of pieces is the outcome if and only if each two
neighbours come out of merging their own characters again, for the first merge across a border would be made in those
two alone as well. So a step of the search allows a piece after another if the two are stable, and exactly one piece
ends each prefix. Models of any other type (unigram, word, character) are refused.

Characters without a piece are bytes. Null texts are empty; empty texts have no ids. Every row counts by itself, and any
column may have any name: only the id and the text are read. Decoding gives the text back except that the model's blank
character, U+2581, comes back as a blank.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshlake.llm.texts import annotate, keeps, read

BLANK = "▁"
#: Pairs that a worker remembers at most (some 100 bytes each), and bytes that it spends on each of two generations of words.
PAIRS, WORD_BYTES = 1 << 19, 64 << 20
_models: dict[str, Model] = {}

FIELDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded", T.BooleanType())])


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message: integers, and bytes of what has a length."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        size = {1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


#: Fixed values of the model file's format: the trainer's settings, the model type among them, and the type of byte-pair models; whether blanks come
#: after words; pieces, with their texts and types, and the type of pieces that users define; the normaliser's settings: its table, a blank before
#: the text, blanks made one, blanks written as the blank character.
TRAINER, MODEL_TYPE, BYTE_PAIR, BLANKS_AFTER = 2, 3, 2, 24
PIECE, PIECE_TEXT, PIECE_TYPE, USER_DEFINED = 1, 1, 3, 4
NORMALISER, TABLE, BLANK_FIRST, ONE_BLANK, BLANK_CHARACTER = 3, 2, 3, 4, 5


def model_type(path: str) -> int:
    with open(path, "rb") as f:
        trainer = next((v for k, v in fields(f.read()) if k == TRAINER), b"")
    return next((v for k, v in fields(trainer) if k == MODEL_TYPE), 1)


def unlike(path: str) -> str | None:
    """Why a model's file isn't of the kind that encode() is for, or None."""
    with open(path, "rb") as f:
        data = list(fields(f.read()))
    trainer, normaliser = (dict(fields(next((v for k, v in data if k == n), b""))) for n in (TRAINER, NORMALISER))
    if trainer.get(MODEL_TYPE, 1) != BYTE_PAIR:
        return "not a byte-pair model"
    if trainer.get(BLANKS_AFTER, 0):
        return "blanks come after words"
    if normaliser.get(TABLE, b""):
        return "texts are normalised by a table"
    if not normaliser.get(BLANK_FIRST, 1) or normaliser.get(ONE_BLANK, 1) or not normaliser.get(BLANK_CHARACTER, 1):
        return "blanks are treated in another way"
    for k, piece in data:
        if k == PIECE:
            made = dict(fields(piece))
            if made.get(PIECE_TYPE, 1) == USER_DEFINED:
                return "users define pieces"
            if BLANK in made[PIECE_TEXT].decode(errors="replace").lstrip(BLANK):
                return "a piece has a blank inside"
    return None


class Model:
    """A piece vocabulary read from a model file: piece to id, scores, and the bytes' ids."""

    def __init__(self, path: str):
        import sentencepiece

        if (why := unlike(path)) is not None:
            raise ValueError(f"{path}: {why}")
        loaded = sentencepiece.SentencePieceProcessor(model_file=path)
        n = loaded.vocab_size()
        self.pieces = [loaded.id_to_piece(i) for i in range(n)]
        self.scores = [loaded.get_score(i) for i in range(n)]
        self.special = {i for i in range(n) if loaded.is_control(i) or loaded.is_unknown(i) or loaded.is_unused(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if loaded.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in self.special and i not in self.of_byte}
        self.shown = [None if i in self.of_byte else "" if i in self.special else p.replace(BLANK, " ") for i, p in enumerate(self.pieces)]
        self.longest = max(map(len, self.ids))
        self.stable: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.held = 0  # bytes of the memo, about
        self.ends: dict[str, int] = {}  # every ending of a piece: the piece's id if it is one that merging makes, else -1
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                self.ends.setdefault(piece[k:], -1)
            self.ends[piece] = i if self.merged(list(piece)) == [piece] else -1

    def merged(self, symbols: list[str]) -> list[str]:
        """symbols with the best pair merged, the leftmost of the best, until no pair is a piece."""
        symbols = list(symbols)
        while True:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = self.ids.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def follows(self, a: int, b: int) -> bool:
        """Whether piece b can come after piece a: the two together come out of merging as they are."""
        key = a << 32 | b
        got = self.stable.get(key)
        if got is None:
            if len(self.stable) >= PAIRS:
                self.stable.clear()
            x, y = self.pieces[a], self.pieces[b]
            got = self.stable[key] = self.merged([*x, *y]) == [x, y]
        return got


def search(model: Model, text: str, back: list[tuple[int | None, int]], stop: int) -> None:
    """Goes on to the place stop: back has the last piece and its length for each place reached so far; -1 is a character
    without a piece."""
    ends, stable, longest = model.ends, model.stable, model.longest
    for n in range(len(back), stop + 1):
        found = (-1, 1)
        for start in range(n - 1, max(-1, n - 1 - longest), -1):
            k = ends.get(text[start:n])
            if k is None:
                break
            if k >= 0:
                last = back[start][0]
                if last is None or last < 0:
                    found = (k, n - start)
                    break
                fits = stable.get(last << 32 | k)
                if fits or (fits is None and model.follows(last, k)):
                    found = (k, n - start)
                    break
        back.append(found)


def path(model: Model, text: str, back: list[tuple[int | None, int]], place: int) -> list[int]:
    """The ids that lead to a place."""
    out: list[int] = []
    while place > 0:
        k, size = back[place]
        if k >= 0:
            out.append(k)
        else:
            out.extend(model.bytes[b] for b in reversed(text[place - size : place].encode()))
        place -= size
    out.reverse()
    return out


class Stream:
    """Ids of characters fed in any portions. text: what isn't final yet; back: for each place in it, the last piece and its
    length. Place 0 of the window is a final boundary, and holds the piece before it."""

    __slots__ = ("model", "text", "back")

    def __init__(self, model: Model):
        self.model, self.text = model, ""
        self.back: list[tuple[int | None, int]] = [(None, 0)]

    def feed(self, characters: str) -> list[int]:
        """The ids that become final with these characters."""
        self.text += characters
        most, out = 4 * self.model.longest, []
        while True:
            n = min(len(self.text), most)
            search(self.model, self.text, self.back, n)
            if n < most:
                return out
            place = self._boundary(n)
            out += self._final(place)
            most = max(4 * self.model.longest, n - place + self.model.longest)

    def _boundary(self, n: int) -> int:
        """The last place that the paths back from all places a coming piece can start from go through."""
        places = set(range(max(0, n - self.model.longest + 1), n + 1))
        while len(places) > 1:
            top = max(places)
            places.remove(top)
            places.add(top - self.back[top][1])
        return places.pop()

    def _final(self, place: int) -> list[int]:
        ids = path(self.model, self.text, self.back, place)
        if place == len(self.text):
            self.text, self.back = "", [(self.back[place][0], 0)]
        elif place:
            self.text, self.back = self.text[place:], [(self.back[place][0], 0), *self.back[place + 1 :]]
        return ids

    def end(self) -> list[int]:
        return self._final(len(self.text))


def load(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    keeps("pieces", _models.clear)
    return _models[path]


def searched(model: Model, word: str) -> bytes:
    """The ids of what lies between two boundaries, as 32-bit numbers."""
    stream = Stream(model)
    return array("i", stream.feed(word) + stream.end()).tobytes()


def packed(model: Model, text: str) -> bytes:
    """Ids of a text, as 32-bit numbers. No piece has a blank after another character, so a blank after one is a boundary whatever comes:
    what lies between two such is searched by itself, once for all its occurrences that are remembered. In a text with single blanks
    between words, a word's key is the word, which stands for a blank and the word; otherwise keys begin with the blank character."""
    if not text:
        return b""
    plain = BLANK not in text and "  " not in text and text[0] != " " and text[-1] != " "
    parts = text.split(" ") if plain else words(text)
    found = list(map(model.memo.get, parts))
    for k, got in enumerate(found):
        if got is None:
            part = parts[k]
            got = model.memo.get(part) or model.elder.get(part) or searched(model, BLANK + part if plain else part)
            found[k] = got
            if len(part) <= 64 and part not in model.memo:
                if model.held > WORD_BYTES:  # words that are still in use have come over into the younger generation
                    model.elder, model.memo, model.held = model.memo, {}, 0
                model.memo[part] = got
                model.held += 272 + 2 * len(part)
    return b"".join(found)


def encode(model: Model, text: str) -> list[int]:
    return array("i", packed(model, text)).tolist()


def words(text: str) -> list[str]:
    """The normal form (blanks as the blank character, one before the text), cut before each blank after another character."""
    made = []
    blanks = BLANK
    for word in text.replace(BLANK, " ").split(" "):  # in the normal form the two are one
        if word:
            made.append(blanks + word)
            blanks = BLANK
        else:
            blanks += BLANK
    if len(blanks) > 1:
        made.append(blanks[:-1])
    return made


def decode(model: Model, ids: Iterable[int]) -> str:
    """The text of ids: bytes that aren't UTF-8 become replacement characters, and the first blank goes."""
    ids = list(ids)
    shown = list(map(model.shown.__getitem__, ids))
    if None not in shown:  # no bytes
        return "".join(shown).removeprefix(" ")
    out: list[str] = []
    raw = bytearray()
    for i, piece in zip(ids, shown, strict=True):
        if piece is None:
            raw.append(model.of_byte[i])
            continue
        if raw:
            out.append(raw.decode(errors="replace"))
            raw.clear()
        out.append(piece)
    if raw:
        out.append(raw.decode(errors="replace"))
    return "".join(out).removeprefix(" ")


def row(model: Model, text: bytes | None) -> tuple:
    text = (text or b"").decode()
    ids = np.frombuffer(packed(model, text), np.int32)
    return ids, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), decode(model, ids.tolist()) == text.replace(BLANK, " ")


def encoded(documents: DataFrame, path: str, doc_id: str | None = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """doc_id (all columns, if None) and a struct: ids, n_ids, ids_sha256 (of the ids as 32-bit little-endian numbers),
    decoded (whether decoding gives the text back). path: a model file that every worker has."""

    def make():
        model = load(path)
        return lambda texts: [row(model, t) for t in texts]

    return annotate(documents, text, FIELDS, make, None if doc_id is None else [doc_id], "pieces")


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded of every document."""
    found, name = encoded(read(spark, sf_dir, "documents"), model_path())
    r = F.col(name)
    return found.select("doc_id", r.n_ids.alias("n_tokens"), r.ids_sha256.alias("ids_sha256"), r.decoded.alias("decoded"))
