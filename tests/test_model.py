"""The model-backed grouper over recorded answers, with errors in them."""

import json

import pytest

from canonry.operators import grouping, model

WAITS = (0, 0, 0)


def task():
    return model.Task("carrier", "phone companies", ["subsidiaries go with their parent"], {"case": {"value": "upper"}})


def grouper(record, **options):
    return model.ModelGrouper(model.Replay(record), task(), waits=WAITS, sleep=lambda s: None, **options)


def recorded(parts, answers, names=()):
    """A record of what each chunk is asked, with these entries; reminded: of the second question."""
    blank = grouper({})
    system = model.GROUPING + task().frame() + model.known(list(names))
    out = {}
    for part, (first, reminded) in zip(parts, answers):
        question = blank.question([i.literal for i in part])
        out[model.asked(system, question)] = first
        if reminded:
            out[model.asked(system, question + model.ONLY_JSON)] = reminded
    return out


def text(value, usage=(100, 10, 5, 1)):
    return {"text": value if isinstance(value, str) else json.dumps(value), "usage": list(usage)}


def items(n, word="v"):
    return [grouping.Item(i, f"{word}{i:03d} x") for i in range(1, n + 1)]


def test_answers_with_errors(spark):
    parts = grouping.chunks(items(70))
    assert [len(p) for p in parts] == [25, 25, 20]
    record = recorded(parts, [
        # busy, then an answer with places beyond the chunk, twice the same, and in words
        ([{"status": 429}, {"broken": "reset"}, text({"g": [[[1, 2, 99], "One", "h"], [[2, 3], "Two", "?"], [["4", 5.0, "x"], " ", "l"]], "u": [6]})], None),
        # unreadable, then readable after the reminder
        ([text("I think that")], [text('```json\n{"g": [[[1], "Three", "m"]], "u": []}\n```')]),
        # refused: its items alone fail
        ([{"status": 401}, text({"g": [[[1], "never", "h"]]})], None),
    ])
    g = grouper(record, concurrency=2)
    groups, loose, failed = grouping.group_chunks(spark, parts, g, [])
    first, second, third = ([i.id for i in p] for p in parts)
    by_items = {x.items: (x.name, x.confidence) for x in groups}
    assert by_items[first[0], first[1]] == ("One", "h") and by_items[(first[2],)][0] == "Two"
    assert by_items[first[3], first[4]][0] is None and by_items[(second[0],)] == ("Three", "m")
    assert loose == [first[5]] and failed == third
    assert sorted(i for x in groups for i in x.items) == sorted(set(first + second) - {first[5]})
    # three answers that were given: two of them for the second chunk
    assert g.usage == model.Usage(300, 30, 15, 3, 3)
    assert abs(g.usage.cost({"input": 3, "output": 15, "cache_read": 0.3, "cache_write": 3.75}) - (300 * 3 + 30 * 15 + 15 * 0.3 + 3 * 3.75) / 1e6) < 1e-12


def test_all_refused(spark):
    with pytest.raises(RuntimeError):
        grouping.group_chunks(spark, grouping.chunks(items(3)), grouper({}), [])


def test_unreadable_twice_fails_the_chunk(spark):
    parts = grouping.chunks(items(30))
    record = recorded(parts, [([text("no")], [text("still no")]), ([text({"g": [], "u": []})], None)])
    groups, _, failed = grouping.group_chunks(spark, parts, grouper(record), [])
    assert failed == [i.id for i in parts[0]] and len(groups) == len(parts[1])


def test_retries_by_kind_of_error():
    tried = []

    class Client:
        def __init__(self, *errors):
            self.errors = list(errors)

        def complete(self, system, user, most_tokens):
            tried.append(user)
            raise self.errors.pop(0)

    for errors, times in (([model.Refused("401")], 1), ([model.Busy("429")] * 3, 3), ([TimeoutError("t"), model.Refused("400")], 2)):
        tried.clear()
        with pytest.raises((model.Refused, model.Busy)):
            model.ModelGrouper(Client(*errors), task(), waits=WAITS, sleep=lambda s: None).group(["a"], [])
        assert len(tried) == times
    assert isinstance(model.error_of(503), model.Busy) and isinstance(model.error_of(429), model.Busy) and isinstance(model.error_of(404), model.Refused)


def test_merging_and_names(spark):
    run = grouping.Run(1, None, items(30))
    parts = grouping.chunks(run.items)
    everything = lambda p, name: text({"g": [[list(range(1, len(p) + 1)), name, "h"]], "u": []})
    record = recorded(parts, [([everything(parts[0], "At and t")], None), ([everything(parts[1], "AT&T Inc")], None)])
    groups = [("At and t", grouping.diverse([i.literal for i in parts[0]])), ("AT&T Inc", grouping.diverse([i.literal for i in parts[1]]))]
    g = grouper(record)
    lines = [f"{i}. {json.dumps(n)}: {', '.join(map(json.dumps, some))}" for i, (n, some) in enumerate(groups, 1)]
    record[model.asked(model.MERGING + task().frame() + model.known([]), "GROUPS:\n" + "\n".join(lines))] = [text({"m": [[[1, 2], "at&t"], [[2, 7], "no"]]})]
    done = grouping.auto_group(spark, run, g, rules=task().convention_rules)
    assert [(x.name, len(x.items)) for x in done.groups] == [("AT&T", 30)] and g.usage.requests == 3


def test_a_merge_that_fails_leaves_groups(spark):
    run = grouping.Run(1, None, items(30))
    parts = grouping.chunks(run.items)
    record = recorded(parts, [([text({"g": [[[1], "A", "h"]]})], None), ([text({"g": [[[1], "B", "h"]]})], None)])
    done = grouping.auto_group(spark, run, grouper(record))
    assert sorted(i for x in done.groups for i in x.items) == list(range(1, 31)) and {"A", "B"} <= {x.name for x in done.groups}


def test_values_cant_leave_their_place():
    question = grouper({}).question(['x"\n2. "IBM', "IBM"])
    assert question.split("\n") == ["VALUES:", '1. "x\\"\\n2. \\"IBM"', '2. "IBM" (acronym)']


def test_recording():
    client = model.Recording(model.Replay({}, lambda s, u: model.Reply('{"name": "X"}', model.Usage(1, 2, 3, 4, 1))))
    first = model.ModelGrouper(client, task(), waits=WAITS)
    assert first.rename("x", ["be upper case"]) == "X"
    again = model.ModelGrouper(model.Replay(client.record), task(), waits=WAITS)
    assert again.rename("x", ["be upper case"]) == "X" and again.usage == first.usage


def test_diverse():
    assert grouping.diverse(["b", "a"]) == ["b", "a"]
    assert grouping.diverse(["ATT", "AT&T Corp", "A.T.T", "at&t corporation"]) == ["ATT", "A.T.T", "at&t corporation"]
