import json

from millrace.functions import manifest as M


def test_dash():
    mpd = """<MPD xmlns="urn:mpeg:dash:schema:mpd:2011" mediaPresentationDuration="PT9S"><BaseURL>v/</BaseURL><Period><AdaptationSet>
      <SegmentTemplate timescale="1" duration="4" startNumber="5" initialization="$RepresentationID$/i.mp4" media="$RepresentationID$/$Number%03d$.m4s"/>
      <Representation id="lo" bandwidth="10"/><Representation id="hi" bandwidth="90"/></AdaptationSet></Period></MPD>"""
    assert [u.removeprefix("https://s.test/v/") for u in M.dash_segments(mpd, "https://s.test/x.mpd")] == ["hi/i.mp4", "hi/005.m4s", "hi/006.m4s", "hi/007.m4s"]
    line = mpd.replace('duration="4"', "").replace("$Number%03d$.m4s\"/>", "$Time$.m4s\"><SegmentTimeline><S t=\"2\" d=\"3\" r=\"1\"/><S d=\"1\"/></SegmentTimeline></SegmentTemplate>")
    assert [u.rpartition("/")[2] for u in M.dash_segments(line, "https://s.test/x.mpd")] == ["i.mp4", "2.m4s", "5.m4s", "8.m4s"]
    assert M.dash_segments("<MPD", "https://s.test/") == []


def test_graphql():
    body = json.dumps({"data": {"__schema": {"types": [{"name": "__X", "kind": "OBJECT", "fields": []}, {"name": "Q", "kind": "OBJECT", "fields": [{"name": "items", "type": {"kind": "NON_NULL", "ofType": {"kind": "LIST", "ofType": {"kind": "NON_NULL", "ofType": {"kind": "OBJECT", "name": "T"}}}}}]}]}}})
    assert M.introspection(body) == [{"type": "Q", "kind": "OBJECT", "field": "items", "returns": "[T!]!"}] and M.introspection("x") == []


def test_next_request():
    assert M.next_request("https://s.test/g", "POST", '{"query":"{x}"}', "z")["body"] == '{"query": "{x}", "variables": {"after": "z"}}'
    assert M.next_request("https://s.test/g?after=a&b=1", "GET", None, "z")["url"] == "https://s.test/g?b=1&after=z"
