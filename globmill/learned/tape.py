"""Reverse-mode derivatives over numpy arrays, and the optimizer that uses them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Value:
    """An array with the way back to what it was made of."""

    __slots__ = ("data", "grad", "parents")

    def __init__(self, data, parents: tuple = ()):
        self.data, self.grad, self.parents = np.asarray(data, float), None, parents

    def __add__(self, other):
        other = value(other)
        return Value(self.data + other.data, ((self, lambda g: _fit(g, self.data.shape)), (other, lambda g: _fit(g, other.data.shape))))

    def __mul__(self, other):
        other = value(other)
        return Value(self.data * other.data, ((self, lambda g: _fit(g * other.data, self.data.shape)), (other, lambda g: _fit(g * self.data, other.data.shape))))

    def __matmul__(self, other):
        def left(g):
            return g @ np.swapaxes(other.data, -1, -2)

        def right(g):
            return _fit(np.swapaxes(self.data, -1, -2) @ g, other.data.shape)

        return Value(self.data @ other.data, ((self, left), (other, right)))

    def __sub__(self, other):
        return self + value(other) * -1.0

    __radd__, __rmul__ = __add__, __mul__

    def _map(self, out: np.ndarray, slope: np.ndarray) -> "Value":
        return Value(out, ((self, lambda g: g * slope),))

    def tanh(self) -> "Value":
        y = np.tanh(self.data)
        return self._map(y, 1 - y * y)

    def sigmoid(self) -> "Value":
        y = 0.5 + 0.5 * np.tanh(0.5 * self.data)
        return self._map(y, y * (1 - y))

    def relu(self) -> "Value":
        return self._map(np.maximum(self.data, 0), (self.data > 0).astype(float))

    def exp(self) -> "Value":
        y = np.exp(self.data)
        return self._map(y, y)

    def log(self) -> "Value":
        return self._map(np.log(self.data), 1 / self.data)

    def inverse(self) -> "Value":
        return self._map(1 / self.data, -1 / self.data**2)

    def sum(self, axis=None, keepdims: bool = False) -> "Value":
        def back(g):
            g = g if axis is None or keepdims else np.expand_dims(g, axis)
            return np.broadcast_to(g, self.data.shape)

        return Value(self.data.sum(axis=axis, keepdims=keepdims), ((self, back),))

    def max(self, axis: int) -> "Value":
        at = np.expand_dims(self.data.argmax(axis), axis)

        def back(g):
            out = np.zeros_like(self.data)
            np.put_along_axis(out, at, np.expand_dims(g, axis), axis)
            return out

        return Value(np.take_along_axis(self.data, at, axis).squeeze(axis), ((self, back),))

    def take(self, index) -> "Value":
        """Rows (or any basic or advanced index)."""

        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, index, g)
            return out

        return Value(self.data[index], ((self, back),))

    def reshape(self, *shape: int) -> "Value":
        return Value(self.data.reshape(*shape), ((self, lambda g: g.reshape(self.data.shape)),))

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p, _ in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            for parent, way in v.parents:
                g = way(v.grad)
                parent.grad = g if parent.grad is None else parent.grad + g


def value(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def _fit(g: np.ndarray, shape: tuple) -> np.ndarray:
    """A gradient summed over what was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(0)
    for k, n in enumerate(shape):
        if n == 1 and g.shape[k] != 1:
            g = g.sum(k, keepdims=True)
    return g


def concat(parts: list[Value], axis: int = -1) -> Value:
    cuts = np.cumsum([p.data.shape[axis] for p in parts])[:-1]
    return Value(np.concatenate([p.data for p in parts], axis), tuple((p, (lambda g, k=k: np.split(g, cuts, axis)[k])) for k, p in enumerate(parts)))


def stack(parts: list[Value], axis: int) -> Value:
    return Value(np.stack([p.data for p in parts], axis), tuple((p, (lambda g, k=k: np.take(g, k, axis))) for k, p in enumerate(parts)))


def softmax(x: Value, axis: int) -> Value:
    e = (x + Value(-x.data.max(axis, keepdims=True))).exp()
    return e * e.sum(axis, True).inverse()


class Parameters(dict):
    """Named arrays; values() of them take part in one forward pass each."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.rng = np.random.default_rng(seed)

    def add(self, name: str, *shape: int, scale: float | None = None) -> None:
        self[name] = self.rng.normal(0, scale if scale is not None else shape[0] ** -0.5, shape) if scale != 0 else np.zeros(shape)

    def opened(self) -> dict[str, Value]:
        return {k: Value(v) for k, v in self.items()}

    def bytes(self) -> int:
        return sum(v.size * 4 for v in self.values())  # as single precision


def train(p: Parameters, loss: Callable[[dict[str, Value], np.ndarray], Value], rows: int, epochs: int, batch: int = 64, rate: float = 0.01, seed: int = 0) -> list[float]:
    """Adam over batches of row numbers; the mean loss of each epoch."""
    rng, told, step = np.random.default_rng(seed), [], 0
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    for _ in range(epochs):
        order, total = rng.permutation(rows), 0.0
        for i in range(0, rows, batch):
            part = order[i : i + batch]
            own = p.opened()
            out = loss(own, part)
            out.backward()
            total += float(out.data) * len(part)
            step += 1
            for k, a in own.items():
                if a.grad is None:
                    continue
                m[k] = 0.9 * m[k] + 0.1 * a.grad
                v[k] = 0.999 * v[k] + 0.001 * a.grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        told.append(total / max(1, rows))
    return told
