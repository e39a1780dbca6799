"""An adaptive radix tree over byte keys, in plain Python, for one bounded piece of keys.

Inner nodes have one of four layouts, for up to 4, 16, 48 and 256 children, and grow
from one to the next. Bytes that all keys below a node share are kept as its
prefix (path compression). A key may be the beginning of another one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class _Listed:
    """Up to ``SIZE`` children beside their sorted bytes."""

    SIZE = 0
    __slots__ = ("labels", "nodes")

    def __init__(self, pairs: Iterator[tuple[int, Node]] = ()):
        self.labels, self.nodes = bytearray(), []
        for label, node in pairs:
            self.labels.append(label)
            self.nodes.append(node)

    def get(self, label: int) -> Node | None:
        at = self.labels.find(label)
        return None if at < 0 else self.nodes[at]

    def put(self, label: int, node: Node) -> None:
        at = bisect_left(self.labels, label)
        if at < len(self.labels) and self.labels[at] == label:
            self.nodes[at] = node
        else:
            self.labels.insert(at, label)
            self.nodes.insert(at, node)

    def full(self) -> bool:
        return len(self.nodes) == self.SIZE

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.labels, self.nodes)


class Layout4(_Listed):
    SIZE = 4
    __slots__ = ()


class Layout16(_Listed):
    SIZE = 16
    __slots__ = ()


class Layout48:
    """A place for each byte, and the children in the order they came."""

    SIZE = 48
    __slots__ = ("places", "nodes")

    def __init__(self, pairs: Iterator[tuple[int, Node]] = ()):
        self.places, self.nodes = bytearray(256), []
        for label, node in pairs:
            self.put(label, node)

    def get(self, label: int) -> Node | None:
        at = self.places[label]
        return self.nodes[at - 1] if at else None

    def put(self, label: int, node: Node) -> None:
        at = self.places[label]
        if at:
            self.nodes[at - 1] = node
        else:
            self.nodes.append(node)
            self.places[label] = len(self.nodes)

    def full(self) -> bool:
        return len(self.nodes) == self.SIZE

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, self.nodes[at - 1]) for label, at in enumerate(self.places) if at)


class Layout256:
    """A child for each byte."""

    SIZE = 256
    __slots__ = ("nodes",)

    def __init__(self, pairs: Iterator[tuple[int, Node]] = ()):
        self.nodes: list[Node | None] = [None] * 256
        for label, node in pairs:
            self.nodes[label] = node

    def get(self, label: int) -> Node | None:
        return self.nodes[label]

    def put(self, label: int, node: Node) -> None:
        self.nodes[label] = node

    def full(self) -> bool:
        return False

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((label, node) for label, node in enumerate(self.nodes) if node is not None)


_NEXT = {Layout4: Layout16, Layout16: Layout48, Layout48: Layout256}


class Node:
    """``prefix`` follows the byte that leads here; ``values`` are those of the key that ends here."""

    __slots__ = ("prefix", "values", "children")

    def __init__(self, prefix: bytes):
        self.prefix = prefix
        self.values: list = []
        self.children: Layout4 | Layout16 | Layout48 | Layout256 | None = None

    def put(self, label: int, node: Node) -> None:
        if self.children is None:
            self.children = Layout4()
        elif self.children.full() and self.children.get(label) is None:
            self.children = _NEXT[type(self.children)](iter(self.children))
        self.children.put(label, node)

    def below(self) -> Iterator[tuple[int, Node]]:
        """Children by their bytes, in order."""
        return iter(self.children) if self.children is not None else iter(())


def shared(a: bytes, b: bytes) -> int:
    """How many bytes two strings begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def add(self, key: bytes, value) -> None:
        above, label, node, at = None, 0, self.root, 0
        while True:
            n = shared(node.prefix, key[at : at + len(node.prefix)])
            if n < len(node.prefix):
                # The key leaves within the prefix: a new node takes its first part.
                upper = Node(node.prefix[:n])
                upper.put(node.prefix[n], node)
                node.prefix = node.prefix[n + 1 :]
                if above is None:
                    self.root = upper
                else:
                    above.put(label, upper)
                node = upper
            at += n
            if at == len(key):
                node.values.append(value)
                return
            below = node.children.get(key[at]) if node.children is not None else None
            if below is None:
                leaf = Node(key[at + 1 :])
                leaf.values.append(value)
                node.put(key[at], leaf)
                return
            above, label, node, at = node, key[at], below, at + 1
