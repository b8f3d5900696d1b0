"""SentencePiece encoding and decoding by a batched Viterbi search.

Words of equal length (longer ones: of about equal length, and the windows of a very long one) advance together: for each end place, the hashes of all substrings that end there probe
the sorted keys of the pieces, and the best predecessor of every word is the largest of the scores by a
vectorised maximum; back-pointers give the segmentation. A character that no piece covers is written as its
UTF-8 bytes. White space follows the vocabulary's rules: a dummy space before the text, each space as U+2581,
nothing removed. No piece has U+2581 after another character, so that words, each with the spaces before it,
can be encoded apart; each different word is encoded once a worker.

Pieces of a vocabulary trained by merges have ranks, not probabilities; their scores here are those of Zipf's
law, the negative logarithm of the rank; pieces outside the ranking come last in it. The result then is the best segmentation under these scores, not the
result of the merges.

Defined cases: a null text has null ids and decodes to null; an empty text has no ids; U+2581 in a text
decodes to a space (as it does in the original); ties go to the longest last piece; ids that aren't in the
vocabulary decode to nothing; an empty table gives an empty result, repeated rows equal results; a text of any
length, with or without spaces, is encoded whole, in time in proportion to its length; other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm.common import mix, powers, slices, text_frame, trim, utf8, vocabulary_path
from evalloom.llm.word_tokens import Encoded, WordTokens, flattened, kept_in_worker, ragged

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spaces and the word after them; pieces never cross a word's end.
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Characters of the words that advance together, and of those of more than ``SHORT`` characters.
BATCH, LONG_BATCH = 400_000, 1_000_000
#: Words up to this length advance with their equals, longer ones with those up to a quarter longer.
SHORT = 24
#: A word of more characters is cut into windows of at least ``WINDOW``, which advance together.
ALONE, WINDOW = 8192, 256
EXACT = float(1 << 30)
#: Words that a worker remembers with their ids; an executor core has two workers, one of them to decode.
REMEMBERED = 200_000
#: Ids that are decoded at once.
IDS = 1_000_000


class Pieces:
    """A vocabulary's pieces: sorted keys with their ids and scores, and byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)]
        self.bytes = {int(self.texts[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(n) if special[i]}
        plain = [i for i in range(n) if not special[i] and not model.is_byte(i)]
        score = {i: model.get_score(i) for i in plain}
        ranks = all(s == round(s) for s in score.values())
        if ranks:
            score = {i: -float(np.log(2.0 + min(-s, n))) for i, s in score.items()}
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece of this vocabulary goes on after a space")
        by_length = sorted(plain, key=lambda i: len(self.texts[i]))
        self.longest = max((len(self.texts[i]) for i in plain), default=1)
        keys = np.array([self.key(self.texts[i]) for i in by_length], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(by_length, np.int64)[order]
        # multiples of 2^-30, so that sums don't depend on how a word is cut
        self.scores = np.round(np.array([score[i] for i in by_length])[order] * EXACT) / EXACT
        # where the keys with each first 16 bits begin
        self.directory = np.append(np.searchsorted(self.keys, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)), len(keys))
        # the bytes that each id decodes to, one after another
        raw = [b"" if i in self.silent else bytes([self.byte_of[i]]) if i in self.byte_of else t.replace(SPACE, " ").encode() for i, t in enumerate(self.texts)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_count = np.array([len(x) for x in raw], np.int64)
        self.raw_begin = np.cumsum(self.raw_count) - self.raw_count
        self.unknown = min(score.values(), default=0.0) if not ranks else float(-np.log(2.0 + n))
        self.unknown = float(np.round((self.unknown - 10.0) * EXACT) / EXACT)

    @staticmethod
    def key(text: str) -> int:
        value = np.zeros(1, np.uint64)
        for c in text:
            value = value * BASE + np.uint64(ord(c) + 1)
        return int(mix(value)[0])

    def segment(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of words of one length (a row of code points each): the length and id of the best last piece at each end. Id -1 is an unknown character."""
        m, n = words.shape
        prefix = np.zeros((n + 1, m), np.uint64)
        power = powers(int(BASE), n + 1)
        for k in range(n):
            prefix[k + 1] = prefix[k] * BASE + words[:, k].astype(np.uint64) + np.uint64(1)
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((n + 1, m), np.int16), np.full((n + 1, m), -1, np.int32)
        for end in range(1, n + 1):
            longest = min(end, self.longest)
            lengths = np.arange(longest, 0, -1)
            key = mix(prefix[end][None, :] - prefix[end - lengths] * power[lengths][:, None])
            at, hit = self.probe(key)
            score = np.where(hit, self.scores[at], -np.inf)
            score[-1] = np.where(hit[-1], score[-1], self.unknown)
            total = best[end - lengths] + score
            choice = total.argmax(0)
            column = np.arange(m)
            best[end] = total[choice, column]
            back[end] = lengths[choice]
            piece[end] = np.where(hit[choice, column], self.ids[at[choice, column]], -1)
        return back, piece

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key among the sorted ones, and whether it is there."""
        first = (key >> np.uint64(48)).astype(np.int64)
        at, end = self.directory[first], self.directory[first + 1]
        more = np.nonzero(at < end)
        hit = np.zeros(key.shape, bool)
        while len(more[0]):
            hit[more] = self.keys[at[more]] == key[more]
            left = ~hit[more] & (at[more] + 1 < end[more])
            more = tuple(x[left] for x in more)
            at[more] += 1
        at[~hit] = 0
        return at, hit

    def encode(self, words: list[str]) -> Encoded:
        """The ids of all words, one after another, and how many each has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        flat, count = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        at, sorted_length = 0, length[order]
        while at < len(order):
            n = int(sorted_length[at])
            most = n if n <= SHORT else min(n + n // 4, ALONE)
            end = at + 1 if n > ALONE else int(np.searchsorted(sorted_length, most, side="right"))
            rows, at = order[at:end], end
            step = max(1, BATCH // max(1, n * min(n, self.longest)) if n <= SHORT else LONG_BATCH // most)
            for s in range(0, len(rows), step):
                own = [words[i] for i in rows[s : s + step].tolist()]
                ids, many = self.encode_equal(own, n) if n <= ALONE else self.encode_long(own[0])
                flat.append(ids)
                count.append(many)
        ids, many = np.concatenate(flat), np.concatenate(count)
        begin, back = np.cumsum(many) - many, np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return ids[ragged(begin[back], many[back])], many[back]

    def encode_equal(self, words: list[str], n: int) -> Encoded:
        """Words of at least ``n`` characters that advance together; shorter ones are filled up, and read from their own ends."""
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        most = int(length.max())
        codes = np.zeros((len(words), most), np.uint32)
        codes[np.arange(most) < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        back, piece = self.segment(codes)
        column, end = np.arange(len(words)), length.copy()
        steps = []
        while end.any():
            steps.append(np.where(end > 0, piece[end, column], -2))
            end = end - np.where(end > 0, back[end, column], 0)
        found = np.array(steps[::-1]).T
        if (found == -1).any():  # characters without a piece: their bytes
            lists = []
            for word, ids, row in zip(words, found.tolist(), back.T.tolist(), strict=True):
                out, at = [], len(word)
                for i in (x for x in reversed(ids) if x != -2):
                    out.extend([i] if i >= 0 else [self.bytes[x] for x in reversed(word[at - 1].encode("utf-8", "replace"))])
                    at -= row[at]
                lists.append(out[::-1])
            return flattened(lists)
        return found[found != -2].astype(np.uint32), (found != -2).sum(1)

    def advance(self, prefix: np.ndarray, starts: np.ndarray, steps: int, best: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of one word advance together from ``starts``. ``best`` has, for each window and column, the scores at the
        start and at the longest - 1 places before it (the last one first); gives those at the windows' ends, and with
        ``keep`` the length and id of the last piece at each place (first column). Places beyond the word stay as they are."""
        n, windows = len(prefix) - 1, np.arange(len(starts))
        lengths = np.arange(self.longest, 0, -1)
        power = powers(int(BASE), self.longest + 1)[lengths]
        back, piece = np.zeros((steps if keep else 0, len(starts)), np.int16), np.full((steps if keep else 0, len(starts)), -1, np.int32)
        for t in range(1, steps + 1):
            end = np.minimum(starts + t, n)
            inside = (starts + t <= n) & (end - lengths[:, None] >= 0)
            begin = np.maximum(end - lengths[:, None], 0)
            at, hit = self.probe(mix(prefix[end][None, :] - prefix[begin] * power[:, None]))
            score = np.where(hit & inside, self.scores[at], -np.inf)
            score[-1] = np.where(hit[-1], score[-1], self.unknown)
            # best[:, i] is i places back, so that a piece of l characters begins at i = l - 1
            total = best[:, lengths - 1] + score.T[:, :, None]
            choice = total.argmax(1)
            if keep:
                first = choice[:, 0]
                back[t - 1] = lengths[first]
                piece[t - 1] = np.where(hit[first, windows], self.ids[at[first, windows]], -1)
            moved = np.concatenate([np.take_along_axis(total, choice[:, None, :], 1), best[:, :-1]], 1)
            best = np.where((starts + t <= n)[:, None, None], moved, best)
        return best, back, piece

    def encode_long(self, word: str) -> Encoded:
        """One word of any length, cut into windows.

        Its windows first advance from each of the places before them at which a piece may end, one column for each; the
        scores at the windows' starts follow from these one after another. With these all windows advance once more, as
        they would have one after another, and the pieces are read from the end. A window is about as long as the root of
        the word, so that a word of n characters takes steps like the root of n."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n, longest = len(codes), self.longest
        window = max(WINDOW, int(np.sqrt(n)))
        starts = np.arange(0, n, window)
        prefix = np.zeros(n + 1, np.uint64)
        value, base, whole = 0, int(BASE), (1 << 64) - 1
        prefix[1:] = np.fromiter((value := (value * base + c + 1) & whole for c in codes.tolist()), np.uint64, n)
        begin = np.full((len(starts), longest, longest), -np.inf)
        begin[:, np.arange(longest), np.arange(longest)] = 0.0
        ends, _, _ = self.advance(prefix, starts, window, begin, False)
        scores = np.full((len(starts), longest), -np.inf)
        scores[0, 0] = 0.0
        for k in range(1, len(starts)):
            scores[k] = (ends[k - 1] + scores[k - 1][None, :]).max(1)
        _, back, piece = self.advance(prefix, starts, window, scores[:, :, None], True)
        back, piece = back.T.ravel()[:n].tolist(), piece.T.ravel()[:n].tolist()
        out, at = [], n
        while at:
            i = piece[at - 1]
            out.extend([i] if i >= 0 else [self.bytes[x] for x in reversed(word[at - 1].encode("utf-8", "replace"))])
            at -= back[at - 1]
        return np.array(out[::-1], np.uint32), np.array([len(out)])

    def decode_all(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The texts of lists of ids, list i from edges[i] on. The first space of a text goes; bytes that aren't UTF-8 are replaced."""
        known = (ids >= 0) & (ids < len(self.texts))
        safe = np.where(known, ids, 0)
        count = np.where(known, self.raw_count[safe], 0)
        ends = np.concatenate([[0], np.cumsum(count)])
        data = self.raw[ragged(self.raw_begin[safe], count)]
        start, end = ends[edges[:-1]], ends[edges[1:]]
        start = start + ((start < end) & (data[np.minimum(start, len(data) - 1)] == 32) if len(data) else 0)
        parts = [data[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return pa.array([x.decode("utf-8", "replace") for x in parts], pa.string())


def vocabulary(path: str) -> tuple[Pieces, WordTokens]:
    def make(path: str) -> tuple[Pieces, WordTokens]:
        pieces = Pieces(path)
        return pieces, WordTokens(pieces.encode, REMEMBERED)

    return kept_in_worker("sentencepieces", path, make)


def encode_slice(texts: pa.Array, tokens: WordTokens) -> Encoded:
    """The ids of all texts, one after another, and the n + 1 places where each text's begin."""
    texts = pc.fill_null(texts, "")
    # runs of spaces, and spaces at an end, belong to one word: such texts are cut by pattern, others at each space
    odd = pc.or_(pc.match_substring_regex(texts, f"  |^ | $|{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(odd)) + 1).tolist(), len(texts)]
    flat, places = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if i == j:
            continue
        if odd[i]:
            number: dict[str, int] = {}
            word: list[int] = []
            edges = [0]
            for text in texts[i:j].to_pylist():
                if text:
                    word.extend([number.setdefault(w, len(number)) for w in WORD.findall(SPACE + text.replace(" ", SPACE))])
                edges.append(len(word))
            ids, at = tokens.of(list(number), np.array(word, np.int64), np.array(edges))
        else:
            lists = pc.split_pattern(texts[i:j], " ")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            coded = lists.values[offsets[0] : offsets[-1]].dictionary_encode()
            ids, at = tokens.of([SPACE + w for w in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), offsets - offsets[0])
        flat.append(ids)
        places.append(at[1:] + places[-1][-1])
    return np.concatenate(flat), np.concatenate(places)


def encode(docs: DataFrame, text_col: str = "text", into: str = "piece_ids", model: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text, array<int>; a column of that name is replaced."""
    path = model or vocabulary_path(VOCABULARY)

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, tokens = vocabulary(path)
        for column in batches:
            _, offsets = utf8(column)
            parts = [pa.array([], pa.list_(pa.int32()))]
            for i, j in slices(offsets):
                ids, at = encode_slice(column[i:j], tokens)
                parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)), mask=column[i:j].is_null()))
            yield pa.concat_arrays(parts)
            del parts
            trim()

    return docs.withColumn(into, encoded(F.col(text_col)))


def decoder(model: str | None = None) -> object:
    """A column function from ids to the text."""
    path = model or vocabulary_path(VOCABULARY)

    @F.arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, tokens = vocabulary(path)
        tokens.forget()
        for column in batches:
            parts = [pa.array([], pa.string())]
            offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            for i, j in slices(offsets, IDS):
                own = column[i:j]
                ids = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                texts = pieces.decode_all(ids, offsets[i : j + 1] - offsets[i])
                parts.append(pc.if_else(own.is_null(), pa.scalar(None, pa.string()), texts))
            yield pa.concat_arrays(parts)
            del parts
            trim()

    return decoded


def decode(docs: DataFrame, ids_col: str = "piece_ids", into: str = "decoded", model: str | None = None) -> DataFrame:
    """``docs`` with the text of each list of ids; a column of that name is replaced."""
    return docs.withColumn(into, decoder(model)(F.col(ids_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(text_frame(spark, sf_dir, "doc_id", "text")))
    ids: Column = F.col("piece_ids")
    return out.select("doc_id", F.size(ids).cast("long").alias("n_pieces"), F.xxhash64(ids).alias("ids_hash"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"), F.sha2("decoded", 256).alias("decoded_sha256"))
