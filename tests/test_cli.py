"""Commands on small files."""

from __future__ import annotations

import json

import pytest
from evalweave import cli
from evalweave.operators import gates


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    data = {"name": "n", "version": "1", "scenarios": [
        {"id": i, "axes": ["x"], "input": {"messages": [{"role": "user", "content": "say hello to all of them now"}]}, "rubric": {"kind": "programmatic", "checker": "keyword", "params": {"expected": ["hello", "them"]}}} for i in ("a", "b")
    ]}
    corpus, record = tmp_path / "c.json", tmp_path / "r.json"
    corpus.write_text(json.dumps(data))
    assert cli.main(["run", str(corpus), "--out", str(record)]) == 0
    made = json.loads(record.read_text())
    assert made["aggregates"][0]["composite"] == 1.0 and len(made["scores"]) == 2

    def said(*argv):
        capsys.readouterr()
        code = cli.main(list(argv))
        return code, capsys.readouterr().out

    assert json.loads(said("list", str(corpus))[1])["scenarios"][0]["id"] == "a"
    assert said("validate", str(record)) == (0, '{\n  "ok": true,\n  "errors": []\n}\n')
    assert "| 1 | stub:echo | 1.000 |" in said("publish", str(record))[1]
    out = json.loads(said("compare", str(record), str(record), "--iterations", "50")[1])
    assert out["eligibility"]["eligible"] and out["interval"]["lower"] == 0.0 and out["composite"]["n"] == 2
    assert json.loads(said("diagnostics", str(corpus))[1])["summary"]["errors"] == 1
    for kind in ("jsonl", "junit", "annotations", "metrics", "summary"):
        assert said("export", str(record), "--format", kind)[1]
    manifest = str(tmp_path / "p.json")
    for action in ("build", "verify", "replay"):
        assert said("proof", action, str(record), str(corpus), "--manifest", manifest)[0] == 0
    assert said("contract", str(corpus))[1].strip() == made["scenarioSetHash"]
    assert json.loads(said("contract", str(corpus), "--schema", "v2", "--fingerprint", "f@1#d")[1])["scenarioCount"] == 2
    assert cli.fingerprint("f@1#d") == {"id": "f", "version": "1", "digest": "d"}
    more = json.loads(said("diagnostics", str(corpus), "--require-outcome", "rare", "--now", "2026-01-01")[1])["audit"]
    assert more["summary"]["blocking_kinds"] == ["duplicate-prompt", "outcome-coverage"] and [f["finding_id"] for f in more["findings"]][:2] == ["D001", "D002"]
    assert "[claim-blocking] duplicate-prompt" in said("diagnostics", str(corpus), "--report")[1]
    for kind in ("spans", "inspect", "portable"):
        assert json.loads(said("export", str(record), "--format", kind, "--dataset", str(corpus))[1])
    assert said("publish", str(record), "--dataset", str(corpus))[0] == 0 and said("validate", str(record), "--contract-hash", "other")[0] == 1
    assert said("publish", str(record), "--contract-hash", "other")[0] == 1
    notes, choices = tmp_path / "a.json", tmp_path / "d.json"
    notes.write_text(json.dumps([{"itemId": "i", "responseId": "r", "label": "pass", "reviewer": "x", "scenarioHash": "h", "rubricVersion": "1", "annotatedAt": "t", "status": "draft"}]))
    choices.write_text(json.dumps({"decisions": [{"itemId": "i", "responseId": "r", "label": "fail", "adjudicator": "y", "adjudicatedAt": "u"}]}))
    made = json.loads(said("human", "adjudicate", str(notes), "--decisions", str(choices))[1])["annotations"]
    assert [(m["label"], m["status"], m["scenario_hash"]) for m in made] == [("pass", "draft", "h"), ("fail", "adjudicated", "h")]


def test_run_refuses_what_it_cannot_score(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *_: spark)
    corpus = tmp_path / "c.json"
    plain = {"id": "a", "axes": ["x"], "input": {"messages": [{"role": "user", "content": "hello"}]}, "rubric": {"kind": "human", "instructions": "be fair"}}
    turns = {"id": "t", "multiTurn": True, "userTurns": ["one"], "persistenceCriteria": [{"id": "c"}]}
    for scenarios, why in (([plain], "annotations"), ([plain | {"rubric": {"kind": "llm-judge"}}], "judge"), ([turns], "multi-turn")):
        corpus.write_text(json.dumps({"name": "n", "version": "1", "scenarios": scenarios}))
        with pytest.raises(SystemExit, match=why):
            cli.main(["run", str(corpus)])


def test_claim_cards():
    card = {"schemaVersion": "claim-card.v1", "dataset": {"name": "n", "version": "1"}, "scenarioSetHash": "h", "hashSchemaVersion": "v1", "status": "allowed", "leaderboardClaimsAllowed": True}
    assert gates.claim_card_errors(card, "2026-01-01") == []
    bad = gates.claim_card_errors(card | {"status": "maybe", "expiresAt": "2025-01-01", "scorerFingerprints": [{}], "leaderboardClaimsAllowed": 1}, "2026-01-01")
    assert [x.split(":")[0] for x in bad] == ["status", "leaderboardClaimsAllowed", "expiresAt", "scorerFingerprints[0].id"]
