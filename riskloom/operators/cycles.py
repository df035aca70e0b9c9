"""Simple cycles of one bounded part of a graph, inside a task.

A simple cycle lies in one block: a piece of a strongly connected part that no single node holds together with the
rest.  A piece gives up the cycles through its smallest node, then loses that node and falls into smaller pieces.  The
walk from the smallest node never returns to a node that could not reach it by the way taken (Johnson's blocking), so
dead ends cost no more than the cycles themselves.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

Graph = dict[int, list[int]]


def strong_parts(nodes: set[int], out: Graph) -> Iterator[list[int]]:
    """Strongly connected parts of two nodes or more, within ``nodes``."""
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_nodes: list[int] = []
    is_open: set[int] = set()
    for root in nodes:
        if root in number:
            continue
        number[root] = low[root] = len(number)
        open_nodes.append(root)
        is_open.add(root)
        road = [(root, iter(out[root]))]
        while road:
            node, onward = road[-1]
            for other in onward:
                if other not in nodes:
                    continue
                if other not in number:
                    number[other] = low[other] = len(number)
                    open_nodes.append(other)
                    is_open.add(other)
                    road.append((other, iter(out[other])))
                    break
                if other in is_open:
                    low[node] = min(low[node], number[other])
            else:
                road.pop()
                if road:
                    low[road[-1][0]] = min(low[road[-1][0]], low[node])
                if low[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(open_nodes.pop())
                    is_open.difference_update(part)
                    if len(part) > 1:
                        yield part


def blocks(part: list[int], both: dict[int, set[int]]) -> Iterator[set[int]]:
    """Blocks of a connected part, cut at articulation nodes; ``both`` has the neighbours either way."""
    inside = set(part)
    root = part[0]
    number = {root: 0}
    low = {root: 0}
    walked = [root]  # nodes in the order met, not yet given to a block
    road = [(root, -1, iter(both[root]))]
    while road:
        node, before, near = road[-1]
        for other in near:
            if other == before or other not in inside:
                continue
            if other not in number:
                number[other] = low[other] = len(number)
                walked.append(other)
                road.append((other, node, iter(both[other])))
                break
            low[node] = min(low[node], number[other])
        else:
            road.pop()
            if before < 0:
                continue
            low[before] = min(low[before], low[node])
            if low[node] >= number[before]:
                block = {before}
                while node not in block:
                    block.add(walked.pop())
                yield block


def pieces(nodes: set[int], out: Graph, both: dict[int, set[int]]) -> Iterator[set[int]]:
    """Strongly connected pieces without an articulation node; a block of a strongly connected part is one itself."""
    for part in strong_parts(nodes, out):
        yield from blocks(part, both)


def circuits(start: int, piece: set[int], out: Graph) -> Iterator[list[int]]:
    """All simple cycles through ``start`` in a strongly connected piece, each begun there."""
    blocked = {start}
    waiting: dict[int, set[int]] = {}  # node -> nodes to open again with it
    path = [start]
    closed = [False]
    road = [iter(out[start])]
    while road:
        for other in road[-1]:
            if other == start:
                closed[-1] = True
                yield path[:]
            elif other not in blocked and other in piece:
                path.append(other)
                closed.append(False)
                blocked.add(other)
                road.append(iter(out[other]))
                break
        else:
            road.pop()
            node = path.pop()
            if closed.pop():
                if closed:
                    closed[-1] = True
                free = [node]
                while free:
                    opened = free.pop()
                    if opened in blocked:
                        blocked.discard(opened)
                        free.extend(waiting.pop(opened, ()))
            else:
                for other in out[node]:
                    if other in piece:
                        waiting.setdefault(other, set()).add(node)


def short_circuits(start: int, piece: set[int], out: Graph, both: dict[int, set[int]], most: int) -> Iterator[list[int]]:
    """Those of at most ``most`` nodes: a step is taken only where the shortest way back is short enough."""
    back = {start: 0}
    pending = deque([start])
    while pending:
        node = pending.popleft()
        for other in both[node]:
            if other in piece and other not in back and node in out[other]:
                back[other] = back[node] + 1
                pending.append(other)
    path, on_path = [start], {start}
    road = [iter(out[start])]
    while road:
        for other in road[-1]:
            if other == start:
                yield path[:]
            elif other in piece and other not in on_path and len(path) + back[other] <= most:
                path.append(other)
                on_path.add(other)
                road.append(iter(out[other]))
                break
        else:
            road.pop()
            on_path.discard(path.pop())


def simple_cycles(out: Graph, share: int = 0, shares: int = 1, most: int | None = None) -> Iterator[list[int]]:
    """Cycles of two nodes or more, each begun at its smallest node; of those, one of ``shares`` parts by that node."""
    both: dict[int, set[int]] = {node: set(to) for node, to in out.items()}
    for node, to in out.items():
        for other in to:
            both[other].add(node)
    pending = [*pieces(set(out), out, both)]
    while pending:
        piece = pending.pop()
        start = min(piece)
        if start % shares == share:
            if most is None:
                yield from circuits(start, piece, out)
            elif most > 1:
                yield from short_circuits(start, piece, out, both, most)
        piece.discard(start)
        if len(piece) > 1:
            pending += pieces(piece, out, both)
