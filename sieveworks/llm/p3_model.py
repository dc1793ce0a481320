"""Character-level bidirectional LSTM with CRF transitions in numpy: training, scoring and decoding."""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ["email", "person_name", "street_address", "phone", "identity_number"]
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
K = len(TAGS)
#: whether a tag (column) may follow another (row)
_FOLLOWS = np.array([[j == 0 or j % 2 == 1 or i in (j - 1, j) for j in range(K)] for i in range(K)])

#: classes of characters: padding, line end, other sign, other letter, then printable ASCII
PAD, BREAK, OTHER, LETTER = range(4)
VOCAB = 4 + 95


def _char_table() -> np.ndarray:
    out = np.full(0x3000, OTHER, np.uint8)
    for code in range(0x3000):
        ch = chr(code)
        if ch in " \n\r\x0b\x0c\x85":  # blanks and line ends are one class: texts are wrapped anywhere
            out[code] = BREAK
            continue
        base = unicodedata.normalize("NFKD", ch)[:1]
        if unicodedata.combining(ch):
            continue
        if ch.isspace():
            base = " "
        elif unicodedata.category(ch) == "Pd":
            base = "-"
        elif ch in "’‘´":
            base = "'"
        elif ch in "“”«»„":
            base = '"'
        elif ch in "øØ":
            base = "o" if ch == "ø" else "O"
        elif ch == "ß":
            base = "s"
        if base and " " <= base <= "~":
            out[code] = 4 + ord(base) - 32
        elif ch.isalpha():
            out[code] = LETTER
    return out


_CHARS = _char_table()


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.full(len(codes), OTHER, np.uint8)
    low = codes < len(_CHARS)
    out[low] = _CHARS[codes[low]]
    return out


def squash(x: np.ndarray, out: np.ndarray, part: np.ndarray) -> None:
    """Nine times a hyperbolic tangent by a ratio of polynomials, flat beyond 3; a fraction of the exact one's time."""
    x.clip(-3, 3, out=out)
    np.multiply(out, out, out=part)
    part += 3
    np.divide(24, part, out=part)
    part += 1
    out *= part


class Tagger:
    """Both directions run in one loop. Gates are cut straight lines, so that padding closes them and resets the state."""

    def __init__(self, hidden: int = 24, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        f = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.h = hidden
        self.p = {
            "x": f(2, VOCAB, 4 * hidden, s=0.3), "u": f(2, hidden, 4 * hidden, s=hidden**-0.5),
            "w": f(2 * hidden, K, s=0.3), "b": np.zeros(K, np.float32), "t": np.zeros((K, K), np.float32), "s": np.zeros(K, np.float32),
        }
        self.p["x"][:, :, hidden : 2 * hidden] += 0.5  # open forget gates

    @classmethod
    def load(cls, path: str) -> Tagger:
        with np.load(path) as f:
            p = {k: f[k].astype(np.float32) for k in f.files}
        out = cls(p["u"].shape[1])
        out.p = p
        return out

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _scaled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weights by gate: of the characters for either direction, of the state, and of the emissions.

        They put gates on a scale to be cut at 0 and 1, padding closes them, and the state is nine times the network's.
        """
        h, p = self.h, self.p
        x, u = p["x"].copy(), p["u"] / 9
        x[..., : 3 * h] = x[..., : 3 * h] * 0.5 + 0.5
        u[..., : 3 * h] *= 0.5
        x[:, PAD, : 3 * h] = -1e4
        w = np.ascontiguousarray(p["w"].reshape(2, h, K).transpose(0, 2, 1) / 9)
        x, u = x.reshape(2 * VOCAB, 4, h).transpose(1, 0, 2), u.reshape(2, h, 4, h).transpose(2, 0, 1, 3)
        return np.ascontiguousarray(x), np.ascontiguousarray(u), w

    def _run(self, ids: np.ndarray, keep: bool):
        """Emissions (length, tags, windows); the states of both directions and what else the gradients need.

        Each gate is one block of memory, so that a character's weights are copied in a piece and steps run over whole blocks.
        """
        n, length = ids.shape
        h = self.h
        x, u, w = self._scaled()
        at = np.concatenate([ids.T, ids.T[::-1].astype(np.intp) + VOCAB], axis=1, dtype=np.intp)
        state, cell, part = (np.zeros((2, n, h), np.float32) for _ in range(3))
        e = np.zeros((length, K, n), np.float32)
        e += self.p["b"][:, None]
        tape = []
        z, row, out = np.empty((4, 2, n, h), np.float32), np.empty((4, 2 * n, h), np.float32), np.empty((2, K, n), np.float32)
        rows, sides = row.reshape(z.shape), z[:3]
        i, f, o, g = z
        turned = lambda a, by=1: a.transpose(0, 2, 1) / np.float32(by)
        for t in range(length + 1):
            if t:
                np.matmul(w, state.transpose(0, 2, 1), out=out)
                e[t - 1] += out[0]
                e[length - t] += out[1]
            if t == length:
                break
            np.matmul(state, u, out=z)
            x.take(at[t], axis=1, out=row, mode="clip")
            z += rows
            sides.clip(0, 1, out=sides)
            g.clip(-1, 1, out=g)
            if keep:
                old = turned(state, 9), turned(cell), z.transpose(1, 0, 3, 2).reshape(2, 4 * h, n)
            cell *= f
            np.multiply(i, g, out=i)
            cell += i
            squash(cell, state, part)
            if keep:
                tape.append((*old, turned(cell), turned(state, 9)))
            state *= o
        return e, [*tape, (turned(state, 9),)]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """(length, tags, windows)."""
        return self._run(ids, False)[0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tag sequences in which an inner tag follows one of its own kind; a bound spares windows the search whose best is all outside.

        A sequence ends with its window's last character, so that padding has no say in it.
        """
        e, last = self.emissions(ids), np.count_nonzero(ids != PAD, axis=1) - 1
        t, s = np.where(_FOLLOWS, self.p["t"], np.float32(-1e4)), self.p["s"]
        tags = np.zeros(ids.shape, np.uint8)
        todo = np.flatnonzero(self._lifted(e, t, last))
        if not len(todo):
            return tags
        score, last = np.ascontiguousarray(e[:, :, todo]), last[todo]
        score[0] += s[:, None]
        step = np.empty((K, K, len(todo)), np.float32)
        for k in range(1, len(e)):
            np.add(score[k - 1][:, None], t[:, :, None], out=step)
            score[k] += step.max(axis=0)
        end = score[last, :, np.arange(len(todo))].argmax(axis=1)
        path = np.empty((len(e), len(todo)), np.uint8)
        path[-1] = at = end
        for k in range(len(e) - 1, 0, -1):
            at = (score[k - 1] + t[:, at]).argmax(axis=0)
            np.copyto(at, end, where=last < k)
            path[k - 1] = at
        tags[todo] = path.T * (ids[todo] != PAD)
        return tags

    def _lifted(self, e: np.ndarray, t: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Windows in which some path may score above the one that is all outside.

        Scores are differences from that path. Of transitions between two spans the best counts for all.
        """
        s, kinds = self.p["s"], np.arange(1, K, 2)
        begin, inner = e[:, 1::2] - e[:, :1], e[:, 2::2] - e[:, :1]
        col = lambda a: np.ascontiguousarray(a - t[0, 0], np.float32)[:, None]
        first, again, close = col(t[0, kinds]), col(t[1:, kinds].max(axis=0)), col(np.maximum(t[kinds, 0], t[kinds + 1, 0]))
        second, on = col(t[kinds, kinds + 1]), col(t[kinds + 1, kinds + 1])
        b, i = begin[0] + (s[kinds] - s[0])[:, None], inner[0] + (s[kinds + 1] - s[0])[:, None]
        now = np.maximum(b, i)
        top, end, first = now.copy(), now.copy(), np.repeat(first, now.shape[1], axis=1)
        for k in range(1, len(e)):
            b += second
            i += on
            np.maximum(i, b, out=i)
            i += inner[k]
            np.maximum(first, now.max(axis=0) + again, out=b)
            b += begin[k]
            np.maximum(b, i, out=now)
            np.copyto(end, now, where=last == k)
            np.maximum(top, now, out=top)
        return (top + close > 0).any(axis=0) | (end > 0).any(axis=0)

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood and its gradients."""
        n, length = ids.shape
        p, h = self.p, self.h
        e, tape = self._run(ids, True)
        out = np.stack([x[0] for x in tape[1:]])  # in running order of each direction
        both = np.concatenate([out[:, 0], out[::-1, 1]], axis=1).transpose(0, 2, 1)  # length, n, 2h
        e = e.transpose(0, 2, 1).astype(np.float64)
        t = p["t"].astype(np.float64)
        lse = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        alpha = np.empty_like(e)
        alpha[0] = p["s"] + e[0]
        for k in range(1, length):
            alpha[k] = lse(alpha[k - 1][:, :, None] + t, 1) + e[k]
        beta = np.zeros_like(e)
        for k in range(length - 2, -1, -1):
            beta[k] = lse(t + (e[k + 1] + beta[k + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        gold = tags.T
        rows = np.arange(n)
        path = p["s"][gold[0]] + sum(e[k][rows, gold[k]] for k in range(length)) + sum(t[gold[k - 1], gold[k]] for k in range(1, length))
        loss = float((z - path).mean())
        de = np.exp(alpha + beta - z[None, :, None])
        for k in range(length):
            de[k][rows, gold[k]] -= 1
        dt = np.zeros((K, K))
        for k in range(1, length):
            dt += np.exp(alpha[k - 1][:, :, None] + t + (e[k] + beta[k])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dt, (gold[k - 1], gold[k]), -1)
        g = {"t": dt / n, "s": de[0].sum(axis=0) / n, "b": de.sum(axis=(0, 1)) / n}
        de = (de / n).astype(np.float32)
        g["w"] = both.reshape(-1, 2 * h).T @ de.reshape(-1, K)
        dboth = de @ p["w"].T
        dout = np.stack([dboth[..., :h], dboth[::-1, :, h:]], axis=1).transpose(0, 1, 3, 2)  # in running order of each direction
        gx, gu = np.zeros_like(p["x"]), np.zeros_like(p["u"])
        dh, dc = np.zeros((2, h, n), np.float32), np.zeros((2, h, n), np.float32)
        eye = np.eye(VOCAB, dtype=np.float32)
        for k in range(length - 1, -1, -1):
            state, cell, z, now, tc = tape[k]
            i, f, o, c = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            dh = dh + dout[k]
            sq = np.minimum(now * now, 9)
            dc = dc + dh * o * ((9 - sq) / (9 + 3 * sq)) ** 2
            open_ = np.concatenate([0.5 * ((z[:, : 3 * h] > 0) & (z[:, : 3 * h] < 1)), abs(c) < 1], axis=1, dtype=np.float32)
            dz = np.concatenate([dc * c, dc * cell, dh * tc, dc * i], axis=1) * open_
            gu += np.matmul(state, dz.transpose(0, 2, 1))
            gx[0] += eye[ids[:, k]].T @ dz[0].T
            gx[1] += eye[ids[:, length - 1 - k]].T @ dz[1].T
            dh = np.matmul(p["u"], dz)
            dc = dc * f
        g["x"], g["u"] = gx, gu
        return loss, g


def train(model: Tagger, gradients, steps: int, rate: float = 0.01, say=print) -> None:
    """Adam with a cosine schedule; ``gradients`` gives the loss and the gradients of the model as it is."""
    m = {k: np.zeros_like(v, np.float64) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in m.items()}
    mean = None
    for step in range(1, steps + 1):
        loss, g = gradients()
        mean = loss if mean is None else 0.98 * mean + 0.02 * loss
        norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        lr = rate * min(1.0, step / 100) * 0.5 * (1 + np.cos(np.pi * step / steps))
        for k, x in g.items():
            x = x * scale
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            model.p[k] = (model.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if step % 100 == 0:
            say(f"step {step}: loss {mean:.3f}")
