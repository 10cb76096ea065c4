"""Compiled models: resolved declarations, grounded rules, scenarios, and their tables.

Models are small and compiled on the driver; what they describe is run on DataFrames (``operators``) or, for one
scenario over a model's own instances, by ``Engine`` on the same fold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..errors import GeometryError, ModelError
from ..operators.machine import KINDS, Fold, Program, Rule
from ..operators.regions import Point, Region, region_table
from .notation import Ref, Shape, Word, read_model

SECONDS = {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0, "day": 86400.0}
METRES = {"m": 1.0, "km": 1000.0}
PREDICATES = {"inside": Region.contains, "coveredBy": Region.covers}
SCALARS = {
    "String": lambda v: isinstance(v, str),
    "Integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "Decimal": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "Boolean": lambda v: isinstance(v, bool),
}
GEOMETRIES = ("Point", "LineString", "Polygon", "Trajectory")
EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def micros(t: datetime) -> int:
    return (t - EPOCH) // timedelta(microseconds=1)


def moment(us: int) -> datetime:
    return EPOCH + timedelta(microseconds=us)


@dataclass(frozen=True)
class Observation:
    subject: str
    property: str
    point: Point
    observed_at: datetime
    observed_at_text: str
    source: str
    confidence: float | None = None
    accuracy_m: float | None = None


@dataclass(frozen=True)
class Constraint:
    name: str
    subject: str
    region: str
    predicate: str
    while_state: str | None = None


@dataclass(frozen=True)
class Violation:
    constraint: str
    subject: str
    region: str
    message: str


@dataclass(frozen=True)
class Entity:
    name: str
    members: dict[str, dict]
    spatial: str | None
    state: str | None


@dataclass(frozen=True)
class Scenario:
    name: str
    moves: tuple[tuple[str, Point], ...]
    run_seconds: float | None
    run_unit: str | None
    run_amount: float | None
    questions: tuple[dict, ...]


@dataclass(frozen=True)
class Report:
    name: str
    started_at: datetime
    completed_at: datetime
    horizon_s: float | None
    events: list[dict]
    answers: list[tuple[str, object]]
    positions: dict[str, Point]
    states: dict[str, str]


def unique(items: list[dict], what: str) -> dict[str, dict]:
    out: dict[str, dict] = {}
    for i in items:
        if i["name"] in out:
            raise ModelError(f"duplicate {what} {i['name']!r}")
        out[i["name"]] = i
    return out


def known(table: dict, name: str, what: str, where: str):
    if name not in table:
        raise ModelError(f"unknown {what} {name!r} in {where}")
    return table[name]


@dataclass
class Model:
    name: str
    version: str
    crs: dict[str, str]
    regions: dict[str, Region]
    entities: dict[str, Entity]
    instances: dict[str, str]
    values: dict[tuple[str, str], object]
    positions: dict[str, Point]
    states: dict[str, str]
    observations: list[Observation]
    constraints: list[Constraint]
    rules: list[Rule]
    scenarios: dict[str, Scenario]

    # -- checks and answers --

    def violations(self, positions: dict[str, Point] | None = None, states: dict[str, str] | None = None) -> list[Violation]:
        positions, states = self.positions if positions is None else positions, self.states if states is None else states
        out = []
        for c in self.constraints:
            if c.while_state is not None and states.get(c.subject) != c.while_state:
                continue
            point, region = positions.get(c.subject), self.regions.get(c.region)
            if point is None:
                message = f"no position of {c.subject}"
            elif region is None:
                message = f"no region {c.region}"
            elif not PREDICATES[c.predicate](region, point):
                message = f"not {c.predicate} {c.region}"
            else:
                continue
            out.append(Violation(c.name, c.subject, c.region, message))
        return out

    def engine(self, clock: datetime) -> Engine:
        return Engine(self, clock)

    def run(self, name: str, start: datetime | None = None, source: Engine | None = None) -> Report:
        """Runs a scenario on a branch of the model's world, or of a live engine's. Neither is changed."""
        scenario = known(self.scenarios, name, "scenario", "the model")
        if start is not None and start.utcoffset() is None:
            raise ModelError("a scenario's start needs a UTC offset")
        observed = max((o.observed_at for o in self.observations), default=EPOCH)
        if source is not None and (source.model.rules != self.rules or source.model.regions != self.regions or set(source.folds) != set(self.instances)):
            raise ModelError("the source engine runs another model")
        branch = source.branch() if source is not None else Engine(self, observed)
        began = max(branch.clock, observed, start or branch.clock)
        events = branch.advance(began)
        for subject, point in scenario.moves:
            events += branch.move(subject, point, began)
        ended = began
        if scenario.run_seconds is not None:
            ended = began + timedelta(seconds=scenario.run_seconds)
            events += branch.advance(ended)
        positions, states = branch.positions, branch.states()
        answers = []
        for q in scenario.questions:
            ref = q["ref"]
            if "predicate" in q:
                answers.append((f"{q['predicate']}({ref}, {q['region']})", PREDICATES[q["predicate"]](self.regions[q["region"]], positions[ref.owner])))
            else:
                entity = self.entities[self.instances[ref.owner]]
                value = positions[ref.owner] if ref.member == entity.spatial else states[ref.owner] if ref.member == entity.state else self.values[ref.owner, ref.member]
                answers.append((str(ref), value))
        return Report(name, began, ended, scenario.run_seconds, events, answers, positions, states)

    # -- tables --

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        members = [
            (e.name, m, d["form"], d.get("type", "State"), d.get("unit"), d.get("crs"), d.get("values"))
            for e in self.entities.values()
            for m, d in e.members.items()
        ]
        make = spark.createDataFrame
        return {
            "regions": region_table(spark, list(self.regions.values())),
            "entities": make(members, "entity string, member string, kind string, type string, unit string, crs string, domain array<string>"),
            "instances": make([(i, e, k) for k, (i, e) in enumerate(self.instances.items())], "instance string, entity string, rank int"),
            "values": make([(i, m, type(v).__name__, str(v)) for (i, m), v in self.values.items()], "instance string, member string, type string, text string"),
            "positions": make([(s, p.x, p.y, p.crs) for s, p in self.positions.items()], "subject string, x double, y double, crs string"),
            "states": make(list(self.states.items()), "subject string, state string"),
            "observations": make(
                [(k, o.subject, o.property, o.point.x, o.point.y, o.point.crs, o.observed_at, o.observed_at_text, o.source, o.confidence, o.accuracy_m) for k, o in enumerate(self.observations)],
                "seq int, subject string, property string, x double, y double, crs string, observed_at timestamp, observed_at_text string, source string, confidence double, accuracy_m double",
            ),
            "constraints": make([(c.name, k, c.subject, c.region, c.predicate, c.while_state) for k, c in enumerate(self.constraints)], "name string, rank int, subject string, region string, predicate string, while_state string"),
            "rules": make([(r.name, k, r.kind, r.subject, r.region, r.from_state, r.to_state, r.duration_us) for k, r in enumerate(self.rules)], "name string, rank int, kind string, subject string, region string, from_state string, to_state string, duration_us long"),
            "scenarios": make(
                [(s.name, k, subject, p.x, p.y, p.crs, None if s.run_seconds is None else round(s.run_seconds * 1e6)) for s in self.scenarios.values() for k, (subject, p) in enumerate(s.moves)],
                "name string, seq int, subject string, x double, y double, crs string, run_us long",
            ),
        }


class Engine:
    """All instances of a model under one clock. Every failed move leaves everything as it was."""

    def __init__(self, model: Model, clock: datetime) -> None:
        self.model, self.clock = model, clock
        self.program = Program(tuple(model.regions), tuple(model.rules))
        self.positions = dict(model.positions)
        self.folds: dict[str, Fold] = {}
        for s in model.instances:
            fold = Fold(self.program, s, model.states.get(s), clock=micros(clock))
            if s in self.positions:
                fold.mask, fold.known, fold.crs = *self._mask(self.positions[s]), self.positions[s].crs
            self.folds[s] = fold

    def _mask(self, p: Point) -> tuple[int, int]:
        mask = bits = 0
        for i, r in enumerate(self.model.regions.values()):
            if r.crs == p.crs:
                bits |= 1 << i
                mask |= r.covers(p) << i
        return mask, bits

    def states(self) -> dict[str, str]:
        return {s: f.state for s, f in self.folds.items() if f.state is not None}

    @property
    def pending(self) -> int:
        return sum(len(f.pending) for f in self.folds.values())

    def branch(self) -> Engine:
        other = Engine(self.model, self.clock)
        other.positions = dict(self.positions)
        for s, f in self.folds.items():
            g = other.folds[s]
            g.state, g.mask, g.known, g.crs, g.clock, g.pending, g.step = f.state, f.mask, f.known, f.crs, f.clock, dict(f.pending), f.step
        return other

    def _event(self, subject: str, row: tuple) -> dict:
        _, phase, _, _, kind, region, name, started, effective, emitted, _, _ = row
        out = {"kind": kind.removeprefix("sustained "), "subject": subject, "region": region}
        if phase == 0:
            out |= {"specification": name, "started_at": moment(started), "effective_at": moment(effective)}
        return out | {"emitted_at": moment(emitted)}

    def advance(self, to: datetime) -> list[dict]:
        if to < self.clock:
            raise ModelError("time cannot go backwards")
        rows = [(s, r) for s, f in self.folds.items() for r in f.advance(micros(to)) if r[0] == "event"]
        self.clock = to
        return [self._event(s, r) for s, r in sorted(rows, key=lambda x: (x[1][2], x[1][3]))]

    def move(self, subject: str, to: Point, at: datetime) -> list[dict]:
        if subject not in self.folds:
            raise ModelError(f"unknown subject {subject!r}")
        if at < self.clock:
            raise ModelError("time cannot go backwards")
        if subject in self.positions and self.positions[subject].crs != to.crs:
            raise ModelError(f"{subject!r} is in {self.positions[subject].crs}, the move in {to.crs}")
        events = self.advance(at)
        mask, bits = self._mask(to)
        events += [self._event(subject, r) for r in self.folds[subject].move(micros(at), mask, bits, to.crs) if r[0] == "event"]
        self.positions[subject] = to
        return events


@dataclass
class _Compiler:
    """Resolves declarations kind by kind, so the text's order is free; the first failure is reported."""

    text: dict
    crs: dict[str, str] = field(default_factory=dict)
    regions: dict[str, Region] = field(default_factory=dict)
    entities: dict[str, Entity] = field(default_factory=dict)

    def of(self, form: str) -> list[dict]:
        return [d for d in self.text["declarations"] if d["form"] == form]

    def point(self, value: object, crs: str, where: str) -> Point:
        if not isinstance(value, Shape) or value.kind != "point":
            raise ModelError(f"{where} needs a point")
        try:
            return Point(*value.corners[0], crs)
        except GeometryError as e:
            raise ModelError(f"{where}: {e}") from e

    def compile(self) -> Model:
        self.crs = {n: d["iri"] for n, d in unique(self.of("crs"), "CRS").items()}
        if not self.crs:
            raise ModelError("a model needs a CRS")
        for n, iri in self.crs.items():
            if not iri:
                raise ModelError(f"CRS {n!r} has no IRI")
        for rank, (n, d) in enumerate(unique(self.of("region"), "region").items()):
            iri = known(self.crs, d["crs"], "CRS", f"region {n!r}")
            if d["shape"].kind != "polygon":
                raise ModelError(f"region {n!r} needs a polygon")
            self.regions[n] = Region.closed(n, d["shape"].corners, iri, rank)
        for n, d in unique(self.of("entity"), "entity").items():
            self.entities[n] = self.entity(n, d)
        instances, values, positions, states = self.instances()
        self.kinds = instances
        observations = [self.observation(d, instances) for d in self.of("observe")]
        constraints = [self.constraint(d, instances) for d in unique(self.of("constraint"), "constraint").values()]
        rules = [r for d in unique(self.of("process"), "process").values() for r in self.rules(d, instances)]
        scenarios = {n: self.scenario(d, instances) for n, d in unique(self.of("scenario"), "scenario").items()}
        return Model(self.text["name"], self.text["version"], self.crs, self.regions, self.entities, instances, values, positions, states, observations, constraints, rules, scenarios)

    def entity(self, name: str, d: dict) -> Entity:
        members: dict[str, dict] = {}
        spatial = state = None
        for m in d["members"]:
            where = f"{name}.{m['name']}"
            if m["name"] in members:
                raise ModelError(f"duplicate member {where!r}")
            members[m["name"]] = m
            if m["form"] == "state":
                if state:
                    raise ModelError(f"entity {name!r} has more than one state")
                if len(set(m["values"])) != len(m["values"]):
                    raise ModelError(f"{where} repeats a state value")
                state = m["name"]
            elif m["type"] in GEOMETRIES:
                if "unit" in m:
                    raise ModelError(f"{where} is spatial and takes no unit")
                if m["type"] != "Point":
                    raise ModelError(f"{where}: geometry type {m['type']} cannot be run")
                if spatial:
                    raise ModelError(f"entity {name!r} has more than one Point")
                if "crs" not in m:
                    raise ModelError(f"{where} needs a CRS")
                known(self.crs, m["crs"], "CRS", where)
                spatial = m["name"]
            elif "crs" in m:
                raise ModelError(f"{where} is not spatial and takes no CRS")
        return Entity(name, members, spatial, state)

    def instances(self) -> tuple[dict[str, str], dict, dict[str, Point], dict[str, str]]:
        kinds, values, positions, states = {}, {}, {}, {}
        for n, d in unique(self.of("instance"), "instance").items():
            entity = known(self.entities, d["entity"], "entity", f"instance {n!r}")
            kinds[n] = entity.name
            given: dict[str, object] = {}
            for a in d["values"]:
                if a["member"] in given:
                    raise ModelError(f"duplicate value of {n}.{a['member']}")
                known(entity.members, a["member"], "member", f"instance {n!r}")
                given[a["member"]] = a["value"]
            for m, declared in entity.members.items():
                where = f"{n}.{m}"
                if m not in given:
                    raise ModelError(f"missing value of {where}")
                v = given[m]
                if m == entity.spatial:
                    positions[n] = self.point(v, self.crs[declared["crs"]], where)
                elif m == entity.state:
                    if not isinstance(v, Word) or v.text not in declared["values"]:
                        raise ModelError(f"{where} is not one of {', '.join(declared['values'])}")
                    states[n] = v.text
                else:
                    if isinstance(v, Shape):
                        raise ModelError(f"{where} takes no geometry")
                    v = v.text if isinstance(v, Word) else v
                    if declared["type"] not in SCALARS:
                        raise ModelError(f"{where} has the unsupported scalar type {declared['type']!r}")
                    if not SCALARS[declared["type"]](v):
                        raise ModelError(f"{where} must be a {declared['type']}")
                    values[n, m] = v
        return kinds, values, positions, states

    def spatial_of(self, ref: Ref, instances: dict[str, str], where: str) -> Entity:
        entity = self.entities[known(instances, ref.owner, "instance", where)]
        known(entity.members, ref.member, "member", where)
        if ref.member != entity.spatial:
            raise ModelError(f"{where}: {ref} is not a Point")
        return entity

    def in_system(self, entity: Entity, region: str, where: str) -> None:
        r = known(self.regions, region, "region", where)
        if self.crs[entity.members[entity.spatial]["crs"]] != r.crs:
            raise ModelError(f"{where}: {entity.spatial} and {region!r} have different CRSs")

    def observation(self, d: dict, instances: dict[str, str]) -> Observation:
        where = f"observation of {d['ref']}"
        entity = self.spatial_of(d["ref"], instances, where)
        try:
            at = datetime.fromisoformat(d["at"])
        except ValueError as e:
            raise ModelError(f"{where}: {d['at']!r} is not an ISO time") from e
        if at.utcoffset() is None:
            raise ModelError(f"{where}: the time needs a UTC offset")
        confidence, accuracy = d.get("confidence"), d.get("accuracy")
        if confidence is not None and not 0 <= confidence <= 1:
            raise ModelError(f"{where}: confidence lies between 0 and 1")
        if accuracy is not None:
            accuracy *= known(METRES, d["unit"], "unit", where)
            if accuracy < 0:
                raise ModelError(f"{where}: accuracy is not negative")
        crs = self.crs[entity.members[entity.spatial]["crs"]]
        return Observation(d["ref"].owner, d["ref"].member, self.point(d["value"], crs, where), at, at.isoformat(), d["source"], confidence, accuracy)

    def constraint(self, d: dict, instances: dict[str, str]) -> Constraint:
        where = f"constraint {d['name']!r}"
        entity = self.spatial_of(d["ref"], instances, where)
        known(self.regions, d["region"], "region", where)
        known(PREDICATES, d["predicate"], "predicate", where)
        self.in_system(entity, d["region"], where)
        if "guard" in d:
            if d["guard"].owner != entity.name:
                raise ModelError(f"{where}: the guard must name the entity {entity.name!r}")
            if d["guard"].member != entity.state:
                raise ModelError(f"{where}: {d['guard']} is not a state")
            if d["state"] not in entity.members[entity.state]["values"]:
                raise ModelError(f"{where}: unknown state {d['state']!r}")
        return Constraint(d["name"], d["ref"].owner, d["region"], d["predicate"], d.get("state"))

    def rules(self, d: dict, instances: dict[str, str]) -> list[Rule]:
        where = f"process {d['name']!r}"
        entity = known(self.entities, d["entity"], "entity", where)
        if d["event"] not in KINDS:
            raise ModelError(f"{where}: unknown event {d['event']!r}")
        if d["ref"].owner != d["parameter"] or d["target"].owner != d["parameter"]:
            raise ModelError(f"{where}: guard and transition must name {d['parameter']!r}")
        if d["ref"].member != entity.spatial:
            raise ModelError(f"{where}: {d['ref']} is not a Point")
        self.in_system(entity, d["region"], where)
        if d["target"].member != entity.state:
            raise ModelError(f"{where}: {d['target']} is not a state")
        for s in (d["from"], d["to"]):
            if s not in entity.members[entity.state]["values"]:
                raise ModelError(f"{where}: unknown state {s!r}")
        us = round(d["amount"] * known(SECONDS, d["unit"], "unit", where) * 1e6) if "amount" in d else None
        return [Rule(f"{d['name']}@{i}", d["event"], d["region"], d["from"], d["to"], us, i) for i, e in instances.items() if e == entity.name]

    def scenario(self, d: dict, instances: dict[str, str]) -> Scenario:
        where = f"scenario {d['name']!r}"
        moves, questions, amount, unit = [], [], None, None
        for c in d["clauses"]:
            if c["form"] == "assume":
                entity = self.spatial_of(c["ref"], instances, where)
                moves.append((c["ref"].owner, self.point(c["value"], self.crs[entity.members[entity.spatial]["crs"]], where)))
            elif c["form"] == "run":
                amount, unit = c["amount"], c["unit"]
                known(SECONDS, unit, "unit", where)
            else:
                q = c["question"]
                if "predicate" in q:
                    known(PREDICATES, q["predicate"], "predicate", where)
                    self.in_system(self.spatial_of(q["ref"], instances, where), q["region"], where)
                else:
                    entity = self.entities[known(instances, q["ref"].owner, "instance", where)]
                    known(entity.members, q["ref"].member, "member", where)
                questions.append(q)
        seconds = None if amount is None else amount * SECONDS[unit]
        return Scenario(d["name"], tuple(moves), seconds, unit, amount, tuple(questions))


def compile_text(source: str, origin: str = "<model>") -> Model:
    return _Compiler(read_model(source, origin)).compile()


def load(path: str) -> Model:
    return compile_text(Path(path).read_text(encoding="utf-8"), str(path))
