"""Placed turns and their contracts as a live stream: what ``evaluate`` finds over whole traces, kept up to date."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tracewright.operators.evaluate import state_facts
from tracewright.operators.traces import place_one
from tracewright.streaming.live import newest, run_to_log

#: Rows of a graph, and of its assertions, that a stream may carry along.
MOST = 5_000
_OPEN = "seq long, entity_type string, entity string"


def _catalogue(df: DataFrame) -> list:
    found = df.limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"a catalogue may have {MOST} rows at most")
    return found


class Placer(StatefulProcessor):
    """Folds one conversation. State: the turn that is open and the state before it, and what the open turn did, each entity and each write of a state once.

    Turns close when a later one begins; rows of turns that are closed come too late and are left out.
    """

    def __init__(self, facts: dict, index: dict, assertions: list) -> None:
        self.facts, self.index, self.assertions = facts, index, assertions
        self.reach = {s: {s, *f[2]} for s, f in facts.items()}
        self.contracts: dict[tuple, list[str]] = {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "turn long, before string")
        self.open = handle.getListState("open", _OPEN)

    def place(self, did: list[tuple], before: str | None) -> tuple[list[str], str]:
        visits: list[str] = []
        for _, kind, entity in sorted(r for r in did if r[1] == "State"):
            if not visits or visits[-1] != entity:
                visits.append(entity)
        seen = [self.index[e] for e in {e for _, kind, e in did if kind != "State"} if e in self.index]
        together = set.intersection(*seen) if seen else set()
        states, _, method = place_one(visits, sorted(together or set().union(*seen)), before, self.reach)
        return states, method

    def contract(self, states: list[str]) -> list[str]:
        """The assertions in force where a turn went through these states, worked out once for each sequence."""
        key = tuple(states)
        if key not in self.contracts:
            known = [self.facts[s] for s in states if s in self.facts]
            inside = {*states, *(x for f in known for part in (f[0], f[1], f[3]) for x in part), *(self.facts[states[-1]][2] if states and states[-1] in self.facts else ())}
            self.contracts[key] = [i for i, scope, about in self.assertions if states and (scope == "journey" or inside & about)]
        return self.contracts[key]

    def row(self, key: tuple, turn: int, states: list[str], method: str, closed: bool) -> tuple:
        return (*key, turn, states, method, self.contract(states), method == "checkpoint", closed)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conversation_id", "turn", "states", "method", "assertions", "certain", "closed"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802
        turn, before = self.last.get() if self.last.exists() else (None, None)
        turns: dict[int, set[tuple]] = {}
        for batch in rows:
            batch = batch[batch["entity"].notna() | ~batch["entity_type"].isin(["State"])]
            for t, seq, kind, entity in zip(batch["turn"], batch["seq"], batch["entity_type"], batch["entity"], strict=True):
                if turn is not None and t < turn:
                    continue
                did = turns.setdefault(int(t), set())
                if isinstance(entity, str) and kind in ("State", "Tool", "Outcome"):
                    did.add((int(seq) if kind == "State" else 0, kind, entity))  # places matter for states alone
        if turn is not None and turns:  # the open turn goes on, or is placed for the last time
            turns.setdefault(int(turn), set()).update(tuple(r) for r in self.open.get())
        out: list[tuple] = []
        for no in sorted(turns):
            if out:  # the turn before is over
                out[-1] = (*out[-1][:-1], True)
            # Where the turn before ended, or else what stood before that: kept, so that an open turn can be placed anew when more of it comes.
            before = out[-1][2][-1] if out and out[-1][2] else before
            states, method = self.place(list(turns[no]), before)
            out.append(self.row(key, no, states, method, False))
        turn = out[-1][1] if out else turn
        if not out:
            return
        self.last.update((turn, before))
        self.open.clear()
        if turns[turn]:  # an empty list is no state
            self.open.put(sorted(turns[turn]))
        yield self.frame(out)

    def close(self) -> None:
        pass


def live_truths(bound: DataFrame, triples: DataFrame, index: DataFrame, assertions: DataFrame) -> DataFrame:
    """``conversation_id, turn, states, method, assertions, certain, closed`` of a stream of bound observations, as far as it has come: every turn placed, with the ids of its contract.

    ``bound``: ``conversation_id, turn, seq, entity_type, entity``; turns of a conversation come in order, a turn may come in several micro-batches. The
    graph and its assertions are catalogues, whose size is checked. Null turns are left out.
    """
    facts = {r["state"]: (r["tools"], r["outcomes"], r["next_states"], r["rules"]) for r in _catalogue(state_facts(triples))}
    states: dict[str, set[str]] = {}
    for r in _catalogue(index):
        states.setdefault(r["entity"], set()).add(r["state"])
    known = [(r["assertion_id"], r["scope"], {r["subject"], *r["expected"]}) for r in sorted(_catalogue(assertions.select("assertion_id", "scope", "subject", "expected")))]
    kind = bound.schema["conversation_id"].dataType.simpleString()
    schema = f"conversation_id {kind}, turn long, states array<string>, method string, assertions array<string>, certain boolean, closed boolean"
    rows = bound.filter("turn IS NOT NULL").select("conversation_id", "turn", "seq", "entity_type", "entity")
    changes = rows.groupBy("conversation_id").transformWithStateInPandas(Placer(facts, states, known), schema, "Update", "None")
    return newest(run_to_log(changes, "update", "truths"), ["conversation_id", "turn"])
