"""The set semantics in plain Python, for tests: the same methods on sets of tuples."""

from __future__ import annotations

from pathloom.functions.paths import is_variable, parse


def _path(p):
    return parse(p) if isinstance(p, str) else tuple(p)


class SetSpace:
    def __init__(self, paths=()):
        self.paths = frozenset(map(_path, paths))

    def _of(self, paths):
        return SetSpace(set(paths))

    def union(self, *others):
        return self._of(self.paths.union(*[o.paths for o in others]))

    def intersection(self, o):
        return self._of(self.paths & o.paths)

    def subtraction(self, o):
        return self._of(self.paths - o.paths)

    def restriction(self, o):
        return self._of(p for p in self.paths if any(p[: len(q)] == q for q in o.paths))

    def raffination(self, o):
        return self.subtraction(self.restriction(o))

    def unwrap(self, path):
        q = _path(path)
        return self._of(p[len(q) :] for p in self.paths if p[: len(q)] == q)

    def wrap(self, path):
        return self._of(_path(path) + p for p in self.paths)

    def composition(self, o):
        return self._of(p + q for p in self.paths for q in o.paths)

    def heads(self, k=1):
        return self._of(p[:k] for p in self.paths if len(p) >= k)

    def tails_union(self):
        return self._of(p[1:] for p in self.paths if p)

    def tails_intersection(self):
        heads = {p[0] for p in self.paths if p}
        return self._of(t for t in {p[1:] for p in self.paths if p} if all((h, *t) in self.paths for h in heads))

    def iterate(self, body, k=1):
        out = set()
        for h in {p[:k] for p in self.paths if len(p) >= k}:
            out |= body(*[(x,) for x in h], self._of(p[k:] for p in self.paths if p[:k] == h and len(p) >= k)).paths
        return self._of(out)

    def tee(self, todo):
        return todo if self.paths else self._of(())

    def on_empty(self, todo):
        return self._of(()) if self.paths else todo

    def or_else(self, backup):
        return self if self.paths else backup

    def first(self, n):
        return self._of(sorted(self.paths)[:n])

    def last(self, n):
        return self._of(sorted(self.paths)[::-1][:n])

    def left_residual(self, o):
        return self._of(p[:i] for p in self.paths for i in range(1, len(p) + 1) if all(p[:i] + q in self.paths for q in o.paths))

    def right_residual(self, o):
        return self._of(p[i:] for p in self.paths for i in range(len(p)) if all(q + p[i:] in self.paths for q in o.paths))

    def card(self):
        return self._of([(str(len(self.paths)),)])

    def transformation(self, pattern, template):
        pattern, template, out = _path(pattern), _path(template), set()
        names = [x for x in pattern if is_variable(x)]
        for p in self.paths:
            got = []
            for own, item in zip(p, pattern):
                if is_variable(item):
                    got.append(own)
                elif own != item:
                    if not is_variable(own):
                        break
                    got.append(item)
            else:
                if all(names.index(x) < len(got) for x in template if is_variable(x)):
                    out.add(tuple(got[names.index(x)] if is_variable(x) else x for x in template))
        return self._of(out)
