"""Minimum cuts of small sparse graphs with integer capacities (shortest augmenting paths)."""

from __future__ import annotations

from collections import deque


def sides(gain: list[int], edges: dict[tuple[int, int], int]) -> list[bool]:
    """The labelling of least cost: True where a node is on the source's side.

    A node i costs ``max(0, gain[i])`` on the sink's side and ``max(0, -gain[i])`` on the
    source's, an edge (i, j) its weight when its ends differ. Nodes whose gain outweighs all their
    edges are settled first (no cheaper labelling can differ there) and their edges are added to
    the gains of their neighbours; the maximum flow runs on what is left. Ties go to the sink.
    """
    gain = list(gain)
    near: list[dict[int, int]] = [{} for _ in gain]
    for (a, b), w in edges.items():
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    weight = [sum(n.values()) for n in near]
    label: list[bool | None] = [None] * len(gain)
    queue = deque(range(len(gain)))
    while queue:
        a = queue.popleft()
        if label[a] is not None or not (gain[a] > weight[a] or -gain[a] >= weight[a]):
            continue
        label[a] = gain[a] > weight[a]
        for b, w in near[a].items():
            del near[b][a]
            weight[b] -= w
            gain[b] += w if label[a] else -w
            if label[b] is None:
                queue.append(b)
        near[a] = {}
    left = [a for a in range(len(gain)) if label[a] is None]
    for a in _source_side(left, gain, near):
        label[a] = True
    return [bool(x) for x in label]


def _source_side(nodes: list[int], gain: list[int], near: list[dict[int, int]]) -> set[int]:
    """Nodes the source still reaches after a maximum flow (Dinic)."""
    source, sink = -1, -2
    room: dict[int, dict[int, int]] = {a: dict(near[a]) for a in nodes}
    room[source] = {a: gain[a] for a in nodes if gain[a] > 0}
    room[sink] = {}
    for a in nodes:
        if gain[a] > 0:
            room[a][source] = 0
        elif gain[a] < 0:
            room[a][sink] = -gain[a]
            room[sink][a] = 0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, r in room[a].items():
                if r > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return set(level) - {source}
        ways = {a: iter(room[a].items()) for a in level}
        path = [source]
        while path:  # one blocking flow, depth first without recursion
            a = path[-1]
            if a == sink:
                least = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= least
                    room[y][x] += least
                cut = next(i for i, (x, y) in enumerate(zip(path, path[1:])) if room[x][y] == 0)
                del path[cut + 1:]
                ways[path[-1]] = iter(list(room[path[-1]].items()))
                continue
            for b, _ in ways[a]:
                if level.get(b) == level[a] + 1 and room[a][b] > 0:
                    path.append(b)
                    break
            else:
                level.pop(a)
                path.pop()
