"""Minimised acyclic acceptors and their composition with a one-edit transducer, on NumPy arrays.

An acceptor holds many word lists at once, one initial state per list.  It is composed with a transducer that copies letters,
makes exactly one edit (replace a letter, or insert one) and copies again, and with itself.  Before the edit both
sides have read the same, so a state of the composition is one state of the acceptor; after it, it is a pair of states.  Pairs from
which no word can be finished are trimmed; the rest is enumerated.  An insertion is made where the two words first differ, so
every accepted pair has one path.
"""

from __future__ import annotations

import numpy as np

_BITS = np.int64(21)  # of a code point


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(matrix of code points, padded with 0; lengths)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    table = np.zeros((len(texts), int(lengths.max(initial=0))), np.int64)
    table[np.arange(table.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    return table, lengths


def _stretched(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, index): every index of the stretches that begin at ``starts``."""
    owner = np.repeat(np.arange(len(starts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]


class Acceptor:
    """The minimised acceptor of word lists.

    ``groups`` and ``words`` are sorted by group, then word, without repeats; ``kinds`` (1, 2...) marks the end of each word, and
    states are equal only if their words end in equal kinds.  ``node_state`` / ``node_row``: the state of every different prefix
    of a group and the first row that has it.  A word's row is that row plus the ``skip`` of each further transition.
    """

    def __init__(self, groups: np.ndarray, words: list[str], kinds: np.ndarray):
        table, lengths = letters_of(words)
        n, width = table.shape
        # shared[i]: how many leading letters row i has in common with the row before it; -1 in a new group.
        shared = np.full(n, -1, np.int64)
        if n > 1:
            equal = (table[1:] == table[:-1]) & (np.arange(width) < np.minimum(lengths[1:], lengths[:-1])[:, None])
            together = groups[1:] == groups[:-1]
            shared[1:] = np.where(together, np.logical_and.accumulate(equal, axis=1).sum(axis=1), -1)
        fresh = (np.arange(width + 1) > shared[:, None]) & (np.arange(width + 1) <= lengths[:, None])
        self.node_row, depth = np.nonzero(fresh)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[self.node_row, depth] = np.arange(len(depth))
        ids = np.maximum.accumulate(ids, axis=0)  # rows below a prefix's first row that have it too
        child = np.flatnonzero(depth > 0)
        parent = ids[self.node_row[child], depth[child] - 1]
        letter = table[self.node_row[child], depth[child] - 1]
        order = np.lexsort((letter, parent))
        child, parent, letter = child[order], parent[order], letter[order]
        ends = np.zeros(len(depth), np.int64)
        ends[ids[np.arange(n), lengths]] = kinds
        first = np.searchsorted(parent, np.arange(len(depth)))
        degree = np.searchsorted(parent, np.arange(len(depth)), "right") - first
        # Height: letters to the longest end.  Equal right languages have equal heights, and children are lower.
        height = np.zeros(len(depth), np.int64)
        has = np.arange(width + 1) <= lengths[:, None]  # row i has a prefix of that length
        np.maximum.at(height, ids[has], (lengths[:, None] - np.arange(width + 1))[has])
        state = np.full(len(depth), -1, np.int64)
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(int(height.max(initial=0)) + 2))
        known, of_node = 0, []
        for level in range(len(cuts) - 1):
            nodes = by_height[cuts[level]:cuts[level + 1]]
            # A state is its kind of end and its transitions, folded one after the other into exact numbers.
            sign = ends[nodes]
            for k in range(int(degree[nodes].max(initial=0))):
                more = np.flatnonzero(degree[nodes] > k)
                edge = first[nodes[more]] + k
                triple = np.stack((sign[more], letter[edge], state[child[edge]]), axis=1)
                _, number = np.unique(triple, axis=0, return_inverse=True)
                # Beyond all signs so far, so that nodes with fewer transitions stay apart.
                sign[more] = number.ravel() + (int(sign.max(initial=0)) + 1)
            _, one, number = np.unique(sign, return_index=True, return_inverse=True)
            state[nodes] = known + number.ravel()
            of_node.append(nodes[one])
            known += len(one)
        model = np.concatenate(of_node) if of_node else np.zeros(0, np.int64)
        self.node_state, self.final = state, ends[model]
        owner, edge = _stretched(first[model], degree[model])
        self.degree = degree[model]
        self.first = np.cumsum(self.degree) - self.degree
        self.letter, self.target = letter[edge], state[child[edge]]
        self.source = owner
        self.key = (owner << _BITS) | self.letter
        # Words below a state; a transition skips the word that ends here and those of earlier transitions.
        size = np.zeros(known, np.int64)
        size[state] = np.bincount(ids[has], minlength=len(depth))
        self.skip = np.zeros(len(edge), np.int64)
        if len(edge):
            before = np.cumsum(size[self.target]) - size[self.target]
            self.skip = before - before[self.first[owner]] + (self.final[owner] > 0)

    def step(self, states: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, transition) of ``states`` on ``letters``."""
        key = (states << _BITS) | letters
        at = np.searchsorted(self.key, key)
        found = at < len(self.key)
        found[found] = self.key[at[found]] == key[found]
        return found, at


class OneEdit:
    """The composition of an acceptor, one edit, and the acceptor again, trimmed.

    Accepted are pairs that both end in kind 1 after a replaced letter, or in kind 1 and 2 after an inserted one; the word without
    the inserted letter, or with the smaller one, comes first.
    """

    def __init__(self, acceptor: Acceptor):
        self.acceptor = a = acceptor
        states = np.arange(len(a.final))
        # Replace: two different transitions of one state.
        left_of = np.repeat(np.arange(len(a.letter)), (a.first + a.degree)[a.source] - np.arange(len(a.letter)) - 1)
        counts = (a.first + a.degree)[a.source] - np.arange(len(a.letter)) - 1
        _, right = _stretched(np.arange(len(a.letter)) + 1, counts)
        swap = (a.source[left_of], a.target[left_of], a.target[right], a.skip[left_of], a.skip[right])
        # Insert: the second word takes a transition alone, then both one on another letter, or both end.
        ends = np.flatnonzero((a.final[a.source] == 1) & (a.final[a.target] == 2))
        self.done = (a.source[ends], np.zeros(len(ends), np.int64), a.skip[ends])
        edge, mine = _stretched(a.first[a.source], a.degree[a.source])
        other = a.letter[mine] != a.letter[edge]
        edge, mine = edge[other], mine[other]
        found, theirs = a.step(a.target[edge], a.letter[mine])
        edge, mine, theirs = edge[found], mine[found], theirs[found]
        put = (a.source[edge], a.target[mine], a.target[theirs], a.skip[mine], a.skip[edge] + a.skip[theirs])
        size = np.int64(max(1, len(states)))
        # A pair of states and the kind in which its second word must end.
        arcs = [np.concatenate(x) for x in zip(swap, put)]
        second = np.concatenate((np.full(len(left_of), 1), np.full(len(edge), 2)))
        code = (arcs[1] * size + arcs[2]) * 2 + (second - 1)
        pairs = seen = np.unique(code)
        sources, targets, skips = [], [], []
        while len(pairs):
            r, s, kind = pairs // 2 // size, pairs // 2 % size, pairs % 2
            which, mine = _stretched(a.first[r], a.degree[r])
            found, theirs = a.step(s[which], a.letter[mine])
            which, mine, theirs = which[found], mine[found], theirs[found]
            to = (a.target[mine] * size + a.target[theirs]) * 2 + kind[which]
            sources.append(pairs[which])
            targets.append(to)
            skips.append((a.skip[mine], a.skip[theirs]))
            pairs = np.setdiff1d(to, seen)
            seen = np.union1d(seen, pairs)
        from_, to = (np.searchsorted(seen, np.concatenate(x)) if x else np.zeros(0, np.int64) for x in (sources, targets))
        mine, theirs = (np.concatenate(x) for x in zip(*skips)) if skips else (np.zeros(0, np.int64),) * 2
        r, s, kind = seen // 2 // size, seen // 2 % size, seen % 2 + 1
        self.accept = (a.final[r] == 1) & (a.final[s] == kind) if len(seen) else np.zeros(0, bool)
        alive = self.accept.copy()
        while True:  # backwards from the ends
            gain = np.unique(from_[alive[to] & ~alive[from_]])
            if not len(gain):
                break
            alive[gain] = True
        keep = alive[from_] & alive[to]
        order = np.argsort(from_[keep], kind="stable")
        self.to, self.skips = to[keep][order], (mine[keep][order], theirs[keep][order])
        counted = np.bincount(from_[keep], minlength=len(seen)) if len(seen) else np.zeros(0, np.int64)
        self.degree, self.first = counted, np.cumsum(counted) - counted
        aim = np.searchsorted(seen, code)
        live = alive[aim] if len(seen) else np.zeros(0, bool)
        order = np.argsort(arcs[0][live], kind="stable")
        self.arcs = [x[live][order] for x in (arcs[0], aim, arcs[3], arcs[4])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(rows, rows) of all accepted pairs."""
        a, lefts, rights = self.acceptor, [], []
        nodes, rows = a.node_state, a.node_row

        def spread(sources, *columns):
            """``columns`` of the arcs of every prefix, beside the prefix's first row."""
            start = np.searchsorted(sources, nodes)
            at, arc = _stretched(start, np.searchsorted(sources, nodes, "right") - start)
            return rows[at], [c[arc] for c in columns]

        row, (mine, theirs) = spread(*self.done)
        lefts.append(row + mine)
        rights.append(row + theirs)
        row, (pair, mine, theirs) = spread(*self.arcs)
        u, v = row + mine, row + theirs
        while len(pair):
            over = self.accept[pair]
            lefts.append(u[over])
            rights.append(v[over])
            which, arc = _stretched(self.first[pair], self.degree[pair])
            pair, u, v = self.to[arc], u[which] + self.skips[0][arc], v[which] + self.skips[1][arc]
        return np.concatenate(lefts), np.concatenate(rights)
