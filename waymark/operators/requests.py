"""Many requests at once: each request's courses are searched, counted and explained in one task, thousands in a job.

A request is a handful of courses with tens of sections each, so its whole state is small; what grows is the number of
requests, which one shuffle on the request's key spreads. Time is cut at every begin and end of a meeting, day by day;
the pieces are bits, a section's meetings are a mask, and two sections conflict where their masks meet, to the minute.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.campus import Rules, Weights
from waymark.operators.travel import shortest_matrix

DAYS = 7


@dataclass(frozen=True)
class Matrix:
    """A campus: building -> place in the square tables of minutes, as given and closed over ways through others."""

    place: dict[int, int]
    minutes: list[list[float]]
    closed: list[list[float]]


def matrix(pairs: DataFrame, most: int = 2000) -> Matrix:
    """The table (a, b, minutes) of a campus of at most `most` buildings; more are refused, as every task gets a copy."""
    rows = pairs.select("a", "b", "minutes").limit(most * most + 1).toPandas()
    ids = np.unique(np.concatenate([rows["a"], rows["b"]])) if len(rows) else np.zeros(0, int)
    if len(ids) > most or len(rows) > most * most:
        raise ValueError(f"a travel matrix of more than {most} buildings")
    table = np.full((len(ids), len(ids)), np.inf)
    table[np.searchsorted(ids, rows["a"]), np.searchsorted(ids, rows["b"])] = rows["minutes"]
    return Matrix({int(b): i for i, b in enumerate(ids)}, table.tolist(), shortest_matrix(table).tolist())


@dataclass(frozen=True)
class Section:
    ord: int
    mask: int
    #: (day, begin, end, position in the section, building)
    meetings: tuple[tuple[int, int, int, int, int], ...]


@dataclass
class Stats:
    nodes: int = 0
    leaves: int = 0
    by_conflict: int = 0
    by_bound: int = 0
    by_rule: int = 0


class Request:
    """The courses of one request, those with the fewest sections first (ties by course); sections by number."""

    def __init__(self, rows: pd.DataFrame, rules: Rules = Rules()) -> None:
        self.rules = rules
        cuts: dict[int, set[int]] = {d: set(rules.lunch[:2]) if rules.lunch else set() for d in range(DAYS)}
        for ms in rows["meetings"]:
            for m in ms if ms is not None else ():
                cuts[int(m["day"])] |= {int(m["s"]), int(m["e"])}
        self.edges, self.shift, at = {d: sorted(c) for d, c in cuts.items()}, {}, 0
        for d in range(DAYS):
            self.shift[d], at = at, at + len(self.edges[d])
        courses: dict[int, list[Section]] = {}
        for course, ordinal, ms in zip(rows["course"], rows["ord"], rows["meetings"], strict=True):
            own = courses.setdefault(int(course), [])
            if not pd.isna(ordinal):
                own.append(self._section(int(ordinal), ms if ms is not None else ()))
        self.courses = {c: sorted(own, key=lambda s: s.ord) for c, own in courses.items()}
        self.order = sorted(self.courses, key=lambda c: (len(self.courses[c]), c))
        self.lunch_bits = [self._bits(d, *rules.lunch[:2]) if rules.lunch else 0 for d in range(DAYS)]
        self._lunch: dict[tuple[int, int], bool] = {}

    def _bits(self, day: int, begin: int, end: int) -> int:
        edges = self.edges[day]
        low, high = edges.index(begin), edges.index(end)
        return ((1 << high) - (1 << low)) << self.shift[day] if high > low else 0

    def _section(self, ordinal: int, ms) -> Section:
        rows = tuple((int(m["day"]), int(m["s"]), int(m["e"]), int(m["mpos"]), int(m["building"])) for m in ms)
        mask = 0
        for day, begin, end, _, _ in rows:
            mask |= self._bits(day, begin, end)
        return Section(ordinal, mask, rows)

    # Rules

    def admitted(self, course: int) -> list[Section]:
        """Sections that keep the free days, and by themselves the lunch hour."""
        return [s for s in self.courses[course] if not any(m[0] in self.rules.free_days for m in s.meetings) and self.lunch(s.mask)]

    def lunch(self, taken: int) -> bool:
        """Whether every day still has the stretch for lunch."""
        return not self.rules.lunch or all(self._free(d, taken & bits) for d, bits in enumerate(self.lunch_bits))

    def _free(self, day: int, taken: int) -> bool:
        if (day, taken) not in self._lunch:
            begin, end, need = self.rules.lunch
            need, run, best = min(need, end - begin), 0, 0
            edges = self.edges[day]
            for i in range(edges.index(begin), edges.index(end)):
                run = 0 if taken >> (self.shift[day] + i) & 1 else run + edges[i + 1] - edges[i]
                best = max(best, run)
            self._lunch[day, taken] = best >= need
        return self._lunch[day, taken]

    # Counting

    def count(self, courses: list[int] | None = None) -> int:
        """The number of feasible combinations, exactly and without making them; 1 of no courses at all.

        Sections of a course with equal masks are a group and count together. After each course, prefixes that shut the
        same groups of later courses (and take the same of the lunch hours) count together. Courses with the most groups
        come first, when there are the fewest prefixes; in the last course it is enough to add up what is not shut.
        """
        courses = sorted((Counter(s.mask for s in self.admitted(c)) for c in (self.order if courses is None else courses)), key=lambda g: -len(g))
        groups = [(i, mask, ways) for i, course in enumerate(courses) for mask, ways in course.items()]
        lunches, states = sum(self.lunch_bits), {(0, 0): 1}
        for i, last in enumerate(range(len(courses), 0, -1)):
            own = [(1 << g, mask, ways) for g, (at, mask, ways) in enumerate(groups) if at == i]
            shuts = [sum(1 << g for g, (at, other, _) in enumerate(groups) if at > i and mask & other) for _, mask, _ in own]
            if last == 1 and not lunches:
                return sum(n * sum(ways for bit, _, ways in own if not shut & bit) for (shut, _), n in states.items())
            later = sum(1 << g for g, (at, _, _) in enumerate(groups) if at > i)
            following: dict[tuple[int, int], int] = defaultdict(int)
            for (shut, taken), n in states.items():
                for (bit, mask, ways), more in zip(own, shuts, strict=True):
                    if not shut & bit:
                        following[(shut | more) & later, taken | mask & lunches] += n * ways
            states = {key: n for key, n in following.items() if self.lunch(key[1])}
        return sum(states.values())

    def conflict_set(self) -> list[int]:
        """Courses that have no schedule together, [] if all have one: those without an admitted section, else the first
        such pair, else what is left when each course in turn is put back only if the others can't do without it."""
        if self.count():
            return []
        bare = [c for c in self.order if not self.admitted(c)]
        if bare:
            return bare
        for i, a in enumerate(self.order):
            for b in self.order[i + 1 :]:
                if not self.count([a, b]):
                    return [a, b]
        left = list(self.order)
        for c in self.order:
            rest = [x for x in left if x != c]
            if not self.count(rest):
                left = rest
        return left

    def with_rules(self, rules: Rules) -> Request:
        rows = [(c, s.ord, [dict(zip(("day", "s", "e", "mpos", "building"), m, strict=True)) for m in s.meetings]) for c, own in self.courses.items() for s in own]
        bare = [(c, None, None) for c, own in self.courses.items() if not own]
        return Request(pd.DataFrame(rows + bare, columns=["course", "ord", "meetings"]), rules)

    def cause(self) -> str:
        """Why there is no schedule: overlap, free_days, lunch, rules (only together); none where there is one."""
        if self.count():
            return "none"
        if not self.with_rules(Rules()).count():
            return "overlap"
        for name, one in (("free_days", Rules(free_days=self.rules.free_days)), ("lunch", Rules(lunch=self.rules.lunch))):
            if one != Rules() and not self.with_rules(one).count():
                return name
        return "rules"

    # Enumeration and search

    def combos(self) -> Iterator[tuple[int, ...]]:
        """Feasible combinations in the order of their sections' numbers, one at a time."""
        options = [self.admitted(c) for c in self.order]

        def grow(depth: int, taken: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
            if depth == len(options):
                yield chosen
                return
            for s in options[depth]:
                if not taken & s.mask and self.lunch(taken | s.mask):
                    yield from grow(depth + 1, taken | s.mask, (*chosen, s.ord))

        return grow(0, 0, ())

    def best(self, k: int, campus: Matrix, home: int, weights: Weights) -> tuple[list[tuple], Stats]:
        """The k cheapest as (cost key, combo, travel, late, gap, days, cost), and what the search went through.

        Branch and bound. A partial schedule's cost over the closed matrix is a bound: there, another stop never makes a
        day cheaper. Costs are sums over days, and a day's cost depends on its meetings only, so days are costed once
        for each set of meetings. At each node the sections are tried from the lowest bound up, until it is above the
        k-th best; ties go by the sections' numbers, so an equal bound goes on. Idle time has no such bound: with a
        weight on it nothing is cut.
        """
        options, stats, found = [self.admitted(c) for c in self.order], Stats(), []
        stats.by_rule = sum(len(self.courses[c]) - len(own) for c, own in zip(self.order, options, strict=True))
        costed: dict[tuple, tuple[float, float, float]] = {}
        start, bounded = campus.place[home], weights.gap == 0

        def day_cost(meetings: tuple, closed: bool) -> tuple[float, float, float]:
            got = costed.get((closed, meetings))
            if got is None:
                table = campus.closed if closed else campus.minutes
                travel = late = gap = spare = 0.0
                here, before, located = start, None, False
                for s, e, _, _, building in meetings:
                    spare += 0 if before is None else s - before
                    before = e
                    there = campus.place.get(building)
                    if there is None:
                        continue
                    way = table[here][there]
                    travel += way
                    if located:
                        late, gap = late + max(0.0, way - spare), gap + max(0.0, spare - way)
                    here, located, spare = there, True, 0.0
                got = costed[closed, meetings] = (travel + (table[here][start] if located else 0.0), late, gap)
            return got

        def total(days: dict[int, tuple], closed: bool) -> tuple[float, float, float, float]:
            parts = [day_cost(ms, closed) for ms in days.values()]
            travel, late, gap = (sum(p[i] for p in parts) for i in range(3))
            return travel, late, gap, weights.travel * travel + weights.late * late + weights.day * len(days) + weights.gap * gap

        def key(cost: float) -> int:
            return int(np.floor(cost * 1000000 + 0.5))

        def grow(depth: int, taken: int, days: dict[int, tuple], chosen: tuple[int, ...]) -> None:
            stats.nodes += 1
            if depth == len(options):
                stats.leaves += 1
                travel, late, gap, cost = total(days, False)
                insort(found, (key(cost), chosen, travel, late, gap, len(days), cost))
                del found[k:]
                return
            tried = []
            for s in options[depth]:
                if taken & s.mask:
                    stats.by_conflict += 1
                elif not self.lunch(taken | s.mask):
                    stats.by_rule += 1
                else:
                    more = dict(days)
                    for day, begin, end, pos, building in s.meetings:
                        more[day] = tuple(sorted((*more.get(day, ()), (begin, end, depth, pos, building))))
                    tried.append((key(total(more, True)[3]) if bounded else 0, s.ord, s.mask, more))
            for i, (low, ordinal, mask, more) in enumerate(sorted(tried, key=lambda t: t[:2])):
                # Sums in another order may differ in the last place: two micro-minutes of room.
                if bounded and len(found) == k and low > found[-1][0] + 2:
                    stats.by_bound += len(tried) - i
                    break
                grow(depth + 1, taken | mask, more, (*chosen, ordinal))

        grow(0, 0, {}, ())
        return found, stats

    def tour_bound(self, campus: Matrix, home: int, exact: int = 12) -> float:
        """The shortest round trip from home through one room of every course, over the closed matrix; 0 of no courses.

        Two courses are as far apart as their nearest rooms, either way; a course with a section without a known room may
        be anywhere, at distance 0. Beyond `exact` courses the spanning tree of least weight, which no tour is below.
        """
        closed, rooms = np.array(campus.closed), []
        for own in self.courses.values():
            places = [[campus.place[m[4]] for m in s.meetings if m[4] in campus.place] for s in own]
            rooms.append(sorted({p for ps in places for p in ps}) if places and all(places) else None)
        stops = [[campus.place[home]], *rooms]
        n = len(stops)
        d = np.zeros((n, n))
        for i in range(n):
            for j in range(i):
                if stops[i] is not None and stops[j] is not None:
                    d[i, j] = d[j, i] = min(closed[np.ix_(stops[i], stops[j])].min(), closed[np.ix_(stops[j], stops[i])].min())
        if n - 1 > exact:
            reach, out, total = d[0].copy(), np.ones(n, bool), 0.0
            out[0] = False
            while out.any():
                u = int(np.where(out, reach, np.inf).argmin())
                total, out[u] = total + reach[u], False
                reach = np.minimum(reach, d[u])
            return float(total)
        if n == 1:
            return 0.0
        # cost[S, j]: from home through all courses of S, ending at j of S.
        m = n - 1
        cost = np.full((1 << m, m), np.inf)
        cost[1 << np.arange(m), np.arange(m)] = d[0, 1:]
        for subset in range(1, 1 << m):
            inside = subset >> np.arange(m) & 1 == 1
            if np.isfinite(cost[subset]).any():
                for j in np.flatnonzero(~inside):
                    cost[subset | 1 << j, j] = min(cost[subset | 1 << j, j], (cost[subset] + d[1:, 1 + j]).min())
        return float((cost[-1] + d[1:, 0]).min())


def choices(sec: DataFrame, mt: DataFrame) -> DataFrame:
    """(request, course, ord, meetings) from sections (request, course, ord) and their meetings (ord, mpos, day, s, e, building).

    A section without meetings stays, with none; a row with a null ord is a wanted course without a section.
    """
    own = mt.groupBy(F.col("ord").alias("of")).agg(F.sort_array(F.collect_list(F.struct("mpos", "day", "s", "e", "building"))).alias("meetings"))
    return sec.select("request", "course", "ord").join(own, F.col("ord") == F.col("of"), "left").drop("of")


def _each(rows: DataFrame, rules: Rules, work: Callable[[Request], dict], schema: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"request": pdf["request"].iloc[0], **work(Request(pdf, rules))}])

    return rows.groupBy("request").applyInPandas(run, f"request {rows.schema['request'].dataType.simpleString()}, {schema}")


def count_schedules(rows: DataFrame, rules: Rules = Rules(), limit: int | None = None) -> DataFrame:
    """(request, n, more): the exact number of feasible combinations of each request, and whether it is above `limit`.

    rows: choices. A wanted course without an admitted section leaves none; requests without rows don't appear. n beyond
    38 digits is null.
    """

    def work(r: Request) -> dict:
        n = r.count()
        return {"n": str(n), "more": limit is not None and n > limit}

    out = _each(rows, rules, work, "n string, more boolean")
    return out.withColumn("n", F.col("n").try_cast("decimal(38,0)"))


def capped_schedules(rows: DataFrame, cap: int, rules: Rules = Rules()) -> DataFrame:
    """(request, combos, complete): the first `cap` feasible combinations in order, and whether these are all."""

    def work(r: Request) -> dict:
        first = list(islice(r.combos(), cap + 1))
        return {"combos": [list(c) for c in first[:cap]], "complete": len(first) <= cap}

    return _each(rows, rules, work, "combos array<array<long>>, complete boolean")


def explain(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(request, feasible, cause, courses): why a request has no schedule, and a smallest set of courses to blame."""

    def work(r: Request) -> dict:
        return {"feasible": r.count() > 0, "cause": r.cause(), "courses": sorted(r.conflict_set())}

    return _each(rows, rules, work, "feasible boolean, cause string, courses array<long>")


def best_schedules(rows: DataFrame, pairs: DataFrame, home: int, k: int, weights: Weights = Weights(), rules: Rules = Rules()) -> DataFrame:
    """(request, best, nodes, leaves, by_conflict, by_bound, by_rule): the k cheapest schedules of each request, in order,
    as array<struct<rank, combo, travel, late, gap, days, cost>>, and the search's numbers."""
    campus = matrix(pairs)
    shared = rows.sparkSession.sparkContext.broadcast(campus)

    def work(r: Request) -> dict:
        found, stats = r.best(k, shared.value, home, weights)
        best = [{"rank": i, "combo": list(c), "travel": t, "late": w, "gap": g, "days": d, "cost": cost} for i, (_, c, t, w, g, d, cost) in enumerate(found, 1)]
        return {"best": best, **vars(stats)}

    return _each(rows, rules, work, "best array<struct<rank:long,combo:array<long>,travel:double,late:double,gap:double,days:long,cost:double>>, nodes long, leaves long, by_conflict long, by_bound long, by_rule long")


def tour_bounds(rows: DataFrame, pairs: DataFrame, home: int, exact: int = 12) -> DataFrame:
    """(request, bound): no schedule's ways of a week that visits every course in one go are shorter."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix(pairs))
    return _each(rows, Rules(), lambda r: {"bound": r.tour_bound(shared.value, home, exact)}, "bound double")
