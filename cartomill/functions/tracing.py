"""The ordered search of a trace: depth first, each node once, over the edges around one start."""

from __future__ import annotations

#: What a search needs of an edge: the file that it leaves, its symbol there, the file that it reaches, its symbol there, its type.
EDGE = ("file", "symbol", "to_file", "to_symbol", "edge_type")


def matches(node: str | None, edge: str | None) -> bool:
    return node is None or edge is None or node == edge or (node.split("::")[1:2] or [""])[0] == edge or edge.split("::")[-1] == node


def searched(start: str, symbol: str | None, edges: list[tuple], depth: int) -> dict:
    """paths (lists of file and symbol), cycles (edges to a node on the way, with the length of the way back), the numbers
    of nodes and edges on the paths, and whether the depth has cut any. edges: in the order in which they are tried."""
    by: dict[str, list[tuple]] = {}
    for e in edges:
        by.setdefault(e[0], []).append(e)
    paths, cycles, seen, deep = [], [], {(start, symbol)}, False
    stack = [(start, symbol)]
    work = [(start, symbol, 0, None)]
    while work:
        file, sym, level, pending = work.pop()
        if pending is None:
            valid = []
            for _, own, to_file, to_symbol, kind in by.get(file, []):
                if not matches(sym, own):
                    continue
                key = (to_file, to_symbol)
                if key in stack:
                    cycles.append({"from": file, "to": to_file, "type": kind, "length": len(stack) - stack.index(key)})
                else:
                    valid.append(key)
            if not valid or level >= depth:
                paths.append(list(stack))
                deep |= level >= depth and bool(valid)
                continue
            pending = iter(valid)
        for key in pending:
            if key not in seen:
                seen.add(key)
                work.append((file, sym, level, pending))
                del stack[level + 1 :]
                stack.append(key)
                work.append((*key, level + 1, None))
                break
        else:
            del stack[level + 1 :]
        if work:
            del stack[work[-1][2] + 1 :]
    pairs = {(a[0], b[0]) for p in paths for a, b in zip(p, p[1:])}
    return {"paths": paths, "cycles": cycles, "nodes": len({n for p in paths for n in p}), "edges": len(pairs), "max_depth_reached": deep}
