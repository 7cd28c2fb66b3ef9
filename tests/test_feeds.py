import json

from catalog import feeds as FD
from quotelab.sources import results as RS
from quotelab.sources import snapshots as SN

SF = "/root/testdata/sf0.001"


def test_scoreboards_are_stored_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(FD, "scratch_dir", lambda spark, purpose: str(tmp_path / purpose))
    assert FD.scoreboard_json(spark, SF).count() > 0
    files = [f.name for f in (tmp_path / "scoreboard").iterdir() if f.name.startswith("part-")]
    assert files and all(f.endswith(".json.lz4") for f in files)


def test_payload_stays_behind_when_quotes_are_deduplicated(spark, tmp_path, monkeypatch):
    doc = {"timestamp": "2024-06-01T12:00:00Z", "data": {"id": "1", "commence_time": "2024-06-01T18:00Z", "home_team": "H", "away_team": "A", "bookmakers": [
        {"key": "b1", "markets": [{"key": "batter_hits", "outcomes": [{"name": "Over", "description": " P1 ", "point": "0.5", "price": "120"}, {"name": "maybe", "description": "P1", "price": "130"}]},
                                  {"key": "unknown", "outcomes": [{"name": "Over", "description": "P1", "point": "0.5", "price": "120"}]}]}]}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    seen, finish = [], SN.finish
    monkeypatch.setattr(SN, "finish", lambda d, *a, **k: seen.append(d.columns) or finish(d, *a, **k))
    got = SN.prop_quotes(spark, str(tmp_path)).collect()
    assert [(r.event_id, r.market, r.subject, r.side, r.line, r.price, r.lead_min) for r in got] == [("1", "batter_hits", "P1", "over", 0.5, 120.0, 360.0)]
    assert not {"home_team", "away_team", "commence_time", "api_key", "description", "name", "point"} & set(seen[0])


def test_last_filled_entry_under_a_key_counts(spark, tmp_path):
    athlete = {"athlete": {"id": "7", "displayName": "P"}, "starter": True, "stats": ["1", "2", "3", None, "x"]}
    doc = {"header": {"id": "1"}, "boxscore": {"players": [{"team": {"abbreviation": "T"}, "statistics": [{"keys": ["atBats", "hits", "atBats", "hits", "walks", "runs"], "athletes": [athlete]}]}]}}
    (tmp_path / "x.json").write_text(json.dumps(doc))
    for schema in (RS.SUMMARY, RS.PLAYER_SUMMARY):
        r = RS.player_rows(RS.read_summaries(spark, str(tmp_path), schema)).first()
        assert (r.at_bats, r.hits, r.walks, r.runs, r.total_bases, r.outs, r.played) == (3.0, 2.0, 0.0, 0.0, 0.0, None, 1.0)
