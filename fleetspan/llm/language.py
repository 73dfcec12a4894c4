"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a
bounded sample of labelled documents, and reads whole texts: windows of WIDTH
bytes with MARGIN bytes of context on either side, every byte once in the middle.
Each position gets a probability for each language; a document's are the mean
over its positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, MARGIN = 128, 12
HIDDEN = 12
LANES = 4096  # windows computed side by side
BYTES_AT_ONCE = 4 << 20
UNKNOWN = "und"
MOST_LANGUAGES = 500  # labels the network is trained for; more are an error in the column


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit. About ``per_language`` documents of each language are sampled by a hash."""

    per_language: int = 600
    window_chars: int = 600
    steps: int = 350
    batch: int = 128
    rate: float = 0.02
    seed: int = 7


def held_out(key: str) -> Column:
    """A fifth of the documents, by a checksum of the key; never used in the fit."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_sample(docs: DataFrame, training: Training, key: str, text: str, lang: str) -> list[tuple[str, str]]:
    """(language, piece of text): about ``per_language`` pieces of each language, at places given by a hash."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    sizes = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if not sizes:
        return []
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages are labelled")
    share = F.lit(0.0)
    for row in sizes:
        share = F.when(F.col(lang) == row["lang"], F.lit(training.per_language / row["n"])).otherwise(share)
    chosen = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(training.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = F.pmod(F.xxhash64(F.lit(training.seed), F.coalesce(F.col(key).cast("string"), F.lit(""))), F.greatest(F.length(text) - training.window_chars, F.lit(1)))
    pieces = labelled.where(chosen < share).select(
        F.col(lang).alias("lang"), F.substring(F.col(text), place.cast("int") + 1, F.lit(training.window_chars)).alias("piece")
    )
    by_lang: dict[str, list[str]] = {row["lang"]: [] for row in sizes}
    for row in sorted(pieces.collect()):  # bounded by the sample
        by_lang[row["lang"]].append(row["piece"])
    return [(name, piece) for name in sorted(by_lang) for piece in by_lang[name][: 2 * training.per_language]]


# One direction: tables of the gates by byte (update, reset, candidate) and the weights from the state to the gates.
# The tables and weights of update and reset hold halves, as sigmoid(x) = tanh(x / 2) / 2 + 1 / 2.


def run_direction(table: np.ndarray, inner: np.ndarray, steps: np.ndarray, keep: int) -> np.ndarray:
    """States (time, hidden, lane) of the last ``keep`` steps; steps holds bytes (time, lane)."""
    width, lanes = inner.shape[1], steps.shape[1]
    h = np.zeros((width, lanes), np.float32)
    x, g = np.empty((3 * width, lanes), np.float32), np.empty((3 * width, lanes), np.float32)
    gates, new = x[: 2 * width], g[2 * width :]
    out, first = np.empty((keep, width, lanes), np.float32), len(steps) - keep
    for t, at in enumerate(steps):
        np.take(table, at, axis=1, out=x, mode="clip")
        np.matmul(inner, h, out=g)
        gates += g[: 2 * width]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        new *= gates[width:]
        new += x[2 * width :]
        np.tanh(new, out=new)
        h -= new
        h *= gates[:width]
        h += new
        if t >= first:
            out[t - first] = h
    return out


def _forward(table: np.ndarray, inner: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, list]:
    width = inner.shape[1]
    h, states, seen = np.zeros((width, steps.shape[1]), np.float32), [], []
    for at in steps:
        x, g = table[:, at], inner @ h
        gates = np.tanh(x[: 2 * width] + g[: 2 * width]) * 0.5 + 0.5
        z, r = gates[:width], gates[width:]
        c = np.tanh(x[2 * width :] + r * g[2 * width :])
        seen.append((h, z, r, c, g[2 * width :]))
        h = c + z * (h - c)
        states.append(h)
    return np.stack(states), seen


def _backward(table: np.ndarray, inner: np.ndarray, steps: np.ndarray, seen: list, into: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and inner, given those of the states."""
    width = inner.shape[1]
    d_inner, gates = np.zeros_like(inner), np.empty((len(steps), *table[:, steps[0]].shape), np.float32)
    carry = np.zeros_like(into[0])
    for t in range(len(steps) - 1, -1, -1):
        before, z, r, c, pre = seen[t]
        dh = into[t] + carry
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * 2 * z * (1 - z)  # the tables hold halves
        dr = dc * pre * 2 * r * (1 - r)
        da = np.concatenate([dz, dr, dc])
        dg = np.concatenate([dz, dr, dc * r])
        d_inner += dg @ before.T
        gates[t] = da
        carry = dh * z + inner.T @ dg
    used, which = np.unique(steps, return_inverse=True)
    d_table = np.zeros_like(table)
    d_table[:, used] = gates.transpose(1, 0, 2).reshape(3 * width, -1) @ np.eye(len(used), dtype=np.float32)[which.ravel()]
    return d_table, d_inner


def _softmax(logits: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


Model = dict[str, np.ndarray]


def train_network(sample: list[tuple[str, str]], training: Training) -> tuple[list[str], Model]:
    """Languages in order and the fitted arrays. Every position of a window is to have the language of its document."""
    languages = sorted({lang for lang, _ in sample})
    rng = np.random.default_rng(training.seed)
    span = WIDTH + 2 * MARGIN
    pieces = [(languages.index(lang), np.frombuffer(b"\0" * MARGIN + p.encode("utf-8", "replace") + b"\0" * span, np.uint8)) for lang, p in sample]
    by_lang = [[p for k, p in pieces if k == n] for n in range(len(languages))]
    width, k = HIDDEN, max(1, len(languages))
    model: Model = {
        name: (rng.normal(size=shape) * scale).astype(np.float32)
        for name, shape, scale in (
            ("table_f", (3 * width, 256), 0.2), ("inner_f", (3 * width, width), 0.25), ("table_b", (3 * width, 256), 0.2),
            ("inner_b", (3 * width, width), 0.25), ("out_f", (k, width), 0.2), ("out_b", (k, width), 0.2), ("bias", (k, 1), 0.0),
        )
    }
    if len(languages) < 2:
        return languages, model
    mean = {n: np.zeros_like(v) for n, v in model.items()}
    square = {n: np.zeros_like(v) for n, v in model.items()}
    for step in range(1, training.steps + 1):
        target = rng.integers(0, k, training.batch)
        lanes = []
        for lang in target:
            piece = by_lang[lang][rng.integers(len(by_lang[lang]))]
            at = rng.integers(0, max(1, len(piece) - 2 * span))
            lanes.append(piece[at : at + span])
        steps = np.stack(lanes, axis=1).astype(np.intp)
        real = (steps[MARGIN : MARGIN + WIDTH] > 0)[:, None, :]
        ahead, back = steps[: MARGIN + WIDTH], steps[MARGIN:][::-1]
        hf, seen_f = _forward(model["table_f"], model["inner_f"], ahead)
        hb, seen_b = _forward(model["table_b"], model["inner_b"], back)
        mid_f, mid_b = hf[MARGIN:], hb[MARGIN:][::-1]
        p = _softmax(model["out_f"] @ mid_f + model["out_b"] @ mid_b + model["bias"], axis=1)
        p[:, target, np.arange(len(target))] -= 1
        d = p * real / max(1, real.sum())
        grads = {
            "out_f": np.einsum("tkn,thn->kh", d, mid_f, optimize=True), "out_b": np.einsum("tkn,thn->kh", d, mid_b, optimize=True),
            "bias": d.sum(axis=(0, 2))[:, None],
        }
        into_f, into_b = np.zeros_like(hf), np.zeros_like(hb)
        into_f[MARGIN:] = model["out_f"].T @ d
        into_b[MARGIN:] = (model["out_b"].T @ d)[::-1]
        grads["table_f"], grads["inner_f"] = _backward(model["table_f"], model["inner_f"], ahead, seen_f, into_f)
        grads["table_b"], grads["inner_b"] = _backward(model["table_b"], model["inner_b"], back, seen_b, into_b)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = training.rate * min(1.0, 1.5 * (1 - step / (training.steps + 1)))
        for n, g in grads.items():  # Adam
            g = g.astype(np.float32) * min(1.0, 1.0 / max(size, 1e-9))
            mean[n] += 0.1 * (g - mean[n])
            square[n] += 0.01 * (g * g - square[n])
            step_size = rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            model[n] -= (step_size * mean[n] / (np.sqrt(square[n]) + 1e-8)).astype(np.float32)
    return languages, model


def read_windows(model: Model, windows: np.ndarray) -> np.ndarray:
    """Probabilities (position, language, window) of the middle bytes of windows (window, byte)."""
    steps = np.ascontiguousarray(windows.T).astype(np.intp)
    hf = run_direction(model["table_f"], model["inner_f"], steps[: MARGIN + WIDTH], WIDTH)
    hb = run_direction(model["table_b"], model["inner_b"], steps[MARGIN:][::-1], WIDTH)
    logits = np.matmul(model["out_f"], hf)
    logits += np.matmul(model["out_b"], hb[::-1])
    logits += model["bias"]
    np.exp(np.clip(logits, -30, 30, out=logits), out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: sums of the probabilities by language, and positions by most probable language."""
    k = model["bias"].shape[0]
    sizes = np.array([len(t) for t in texts], np.int64)
    windows = -(-sizes // WIDTH)
    buffer = bytearray(MARGIN)
    for t, n in zip(texts, windows.tolist()):
        buffer += t
        buffer += b"\0" * (n * WIDTH - len(t) + 2 * MARGIN)
    data = np.frombuffer(bytes(buffer) + b"\0" * (WIDTH + MARGIN), np.uint8)
    first = MARGIN + np.cumsum(windows * WIDTH + 2 * MARGIN) - (windows * WIDTH + 2 * MARGIN)
    owner = np.repeat(np.arange(len(texts)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[owner] + inside * WIDTH - MARGIN
    lengths = np.minimum(WIDTH, sizes[owner] - inside * WIDTH)
    sums, counts = np.zeros((len(texts), k)), np.zeros((len(texts), k), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(data, WIDTH + 2 * MARGIN)
    for a in range(0, len(owner), LANES):
        at = slice(a, a + LANES)
        p = read_windows(model, view[starts[at]])
        real = np.arange(WIDTH)[:, None] < lengths[at][None, :]
        p *= real[:, None, :]
        best = np.where(real, p.argmax(axis=1), k)
        np.add.at(sums, owner[at], p.sum(axis=0, dtype=np.float64).T)
        for lang in range(k):
            np.add.at(counts[:, lang], owner[at], (best == lang).sum(axis=0))
    return sums, counts


def position_labels(languages: list[str], model: Model, text: str) -> list[str]:
    """The label of every byte of one text."""
    data = text.encode("utf-8", "replace")
    padded = np.frombuffer(b"\0" * MARGIN + data + b"\0" * (2 * WIDTH + MARGIN), np.uint8)
    out: list[str] = []
    for at in range(0, len(data), WIDTH):
        out += [languages[i] for i in read_windows(model, padded[None, at : at + WIDTH + 2 * MARGIN])[:, :, 0].argmax(axis=1)]
    return out[: len(data)]


def language_column(languages: list[str], model: Model, text: str) -> Column:
    """lang_pred, score, n_positions and agreeing (positions whose own label is the document's)."""

    @F.pandas_udf("lang_pred string, score double, n_positions long, agreeing long")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list[tuple] = [(UNKNOWN, 0.0, 0, 0)] * len(texts)
            work: list[int] = []
            held: list[bytes] = []
            room = BYTES_AT_ONCE

            def settle() -> None:
                sums, counts = pooled(model, held)
                for i, total, count in zip(work, sums, counts):
                    n = int(count.sum())
                    k = int(total.argmax())
                    rows[i] = (languages[k], min(1.0, float(total[k] / n)), n, int(count[k]))

            for i, text in enumerate(texts):
                if text and languages and any(map(str.isalpha, text)):
                    work.append(i)
                    held.append(text.encode("utf-8", "replace"))
                    room -= len(held[-1])
                    if room <= 0:
                        settle()
                        work, held, room = [], [], BYTES_AT_ONCE
            if work:
                settle()
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "n_positions", "agreeing"])

    return label(F.col(text))


def fitted(docs: DataFrame, training: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[list[str], Model]:
    return train_network(training_sample(docs, training, key, text, lang), training)


def identify_language(
    docs: DataFrame, training: Training = Training(), key: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions and agreeing of every row.

    A text that is null or has no letter is ``und`` with score 0, as is every text
    when no document is labelled; with a single labelled language that one is the
    answer for all others. A null key is never held out. Equal texts get equal
    predictions, so repeated rows agree. Language, source and key are no inputs of
    a prediction; other columns of ``docs`` play no part.
    """
    languages, model = fitted(docs, training, key, text, lang)
    found = docs.select(
        F.col(key).alias("doc_id"), held_out(key).alias("held_out"), language_column(languages, model, text).alias("found")
    )
    return found.select("doc_id", "held_out", "found.*")
