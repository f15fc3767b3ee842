"""Exact comparison of bounded groups of sets inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tabprobe.llm._common import distinct


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A sorted partition as tables of whole groups of equal keys, about ``rows`` rows each, with the rows at which
    the groups begin and the end. A longer group makes a table of its own."""
    held: list[pa.RecordBatch] = []
    have = 0

    def edges(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = table.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.append(np.flatnonzero(new), table.num_rows)

    for batch in batches:
        held.append(batch)
        have += batch.num_rows
        if have >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = edges(table)
            if len(cut) > 2:  # the last group may go on in the next batch
                yield table.slice(0, cut[-2]), cut[:-1]
            held, have = table.slice(cut[-2]).to_batches(), 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table, edges(table)


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node of each of ``n`` nodes' component, by hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def links_of(items: np.ndarray, cut: np.ndarray, block: np.ndarray, weight: np.ndarray, across: bool, threshold: float):
    """(a, b, links, least) of rows whose sets of whole numbers (row i: ``items[cut[i]:cut[i + 1]]``) have a Jaccard similarity of ``threshold`` or more:
    a spanning forest of the links, each row's sum of its partners' weights and its first partner (a row number;
    the row's own where it has none). ``across``: only pairs of different blocks count."""
    sizes = np.diff(cut)
    order = np.argsort(sizes, kind="stable")
    codes = np.searchsorted(distinct(items), items)
    flat = np.concatenate([codes[cut[i]:cut[i + 1]] for i in order])
    size = sizes[order]
    start = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(codes.max() + 1, np.int8)
    links, least = np.zeros(len(size), np.int64), np.arange(len(size))
    a_out, b_out = [], []
    for i in range(len(size)):
        last = int(np.searchsorted(size, size[i] / threshold + 1e-9, "right"))  # larger sets within the length bound
        if last <= i + 1:
            continue
        own = flat[start[i]:start[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[flat[start[i + 1]:start[last]]], start[i + 1:last] - start[i + 1], dtype=np.int64)
        mark[own] = 0
        hit = shared >= threshold * (size[i] + size[i + 1:last] - shared) - 1e-9
        me, others = order[i], order[i + 1:last]
        if across:
            hit &= block[others] != block[me]
        near = others[hit]
        if len(near):
            links[me] += weight[near].sum()
            links[near] += weight[me]
            least[me] = min(near.min(), least[me]) if least[me] != me else near.min()
            alone = least[near] == near
            least[near] = np.where(alone, me, np.minimum(least[near], me))
            a_out.append(np.full(len(near), me))
            b_out.append(near)
    if a_out:
        root = components_of(np.concatenate(a_out), np.concatenate(b_out), len(size))
        child = np.flatnonzero(root != np.arange(len(root)))
        return child, root[child], links, least
    none = np.empty(0, np.int64)
    return none, none, links, least
