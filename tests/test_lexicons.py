"""Lexicons other than the shipped one: no hit may be lost to a short cut of the scan."""

import json
import re

from tidewell.functions.text import hinted, literal_starts
from tidewell.operators import scan
from tidewell.sources.lexicon import read_lexicon


def _write(folder, level, **parts):
    (folder / f"l{level}.json").write_text(json.dumps({"level": level, "name": f"l{level}", **parts}))


def _levels(spark, folder, texts):
    matchers = scan.load_matchers(read_lexicon(spark, str(folder)))
    rows = scan.scan_messages(spark.createDataFrame(list(enumerate(texts)), "case_id long, text string"), matchers).collect()
    return {texts[r["case_id"]]: r["level"] for r in rows}


def test_a_template_with_its_own_regex_is_not_tied_to_its_slots(spark, tmp_path):
    _write(tmp_path, 3, components={"starters": ["i want to"], "self_harm_actions": ["vanish forever"]}, regex_templates=[
        {"id": "own", "slots": ["starters", "self_harm_actions"], "regex": "i want to (?:vanish forever|go away for good)"}])
    got = _levels(spark, tmp_path, ["i want to go away for good", "i want to vanish forever", "what a nice day"])
    assert list(got.values()) == [4, 4, 0]


def test_one_id_in_two_documents_keeps_its_own_phrases(spark, tmp_path):
    _write(tmp_path, 1, components={"states": ["quite tired"]}, regex_templates=[{"id": "u", "slots": ["states"]}])
    _write(tmp_path, 2, components={"states": ["wholly crushed"]}, regex_templates=[{"id": "u", "slots": ["states"]}])
    texts = ["today i feel quite tired of it", "today i feel wholly crushed by it", "all is well"]
    assert list(_levels(spark, tmp_path, texts).values()) == [1, 2, 0]


def test_a_rule_with_a_top_level_alternative_finds_both(spark, tmp_path):
    _write(tmp_path, 3, regex_rules=[{"id": "r", "regex": r"\b(?:alpha|beta) ends|\bdelta starts"}])
    texts = ["alpha ends", "delta starts", "beta ends", "gamma"]
    assert list(_levels(spark, tmp_path, texts).values()) == [4, 4, 4, 0]


def test_hints_never_lose_a_match():
    for pattern in (r"\b(?:a|b)x|\bdy", r"\b(?:a|b)[|)]x", r"\b(?:ab|cd)(?:e|f)", r"\b(?:a|b)\|x", r"\b(?:a|b)x(?:c|d)|(?:dy)"):
        guarded = hinted(pattern, literal_starts(pattern))
        for text in ("zz dy", "ax", "b|x", "a)x", "abe", "cdf", "b|x", "axc dy", "zz"):
            assert bool(re.search(pattern, text)) == bool(re.search(guarded, text)), (pattern, text)
