"""Results as text and as single-line JSON; rows are those of a result, gathered by the caller who asks for text.

The wording and the layout of lines are fixed values: programs read them.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterable

from ..functions.timeutil import format_ns
from ..plans.compiler import Result
from ..schema import EVENT_NAMES


def _end(ns: int | None) -> str:
    return "open" if ns is None else format_ns(ns)


def single(value: float) -> str:
    """The shortest decimal that is the same 32-bit float; whole numbers without a fraction."""
    held = struct.unpack("f", struct.pack("f", value))[0]
    text = next(t for t in (f"{held:.{n}g}" for n in range(1, 18)) if struct.unpack("f", struct.pack("f", float(t)))[0] == held)
    return format(float(text), "f").rstrip("0").rstrip(".") if "e" in text else text


def prop_value(prop) -> object:
    """A stored property as a Python value; bytes as bytes."""
    kind, text = prop["t"], prop["v"]
    return {"null": lambda: None, "bool": lambda: text == "true", "int": lambda: int(text), "float": lambda: float(text), "string": lambda: text, "bytes": lambda: base64.b64decode(text)}[kind]()


def _json_prop(prop) -> object:
    value = prop_value(prop)
    if isinstance(value, bytes):
        return "<bytes>"
    if isinstance(value, float):
        return None if value != value or value in (float("inf"), float("-inf")) else int(value) if value.is_integer() and abs(value) < 1e15 else value
    return value


def _dump(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def edge_line(e) -> str:
    return f"{e['from_ext_id']:<12} -[{e['edge_type']}]-> {e['to_ext_id']:<12}  valid=[{format_ns(e['valid_from_ns'])}..{_end(e['valid_to_ns'])})  obs={format_ns(e['observed_at_ns'])}  src={e['source'] or '-'}  conf={e['confidence']:.2f}"


def path_line(edges: list) -> str:
    if not edges:
        return "(source == target)"
    return edges[0]["from_ext_id"] + "".join(f" -[{e['edge_type']}]-> {e['to_ext_id']}" for e in edges)


def entry_line(e) -> str:
    sign = {"node_added": "+ node", "node_removed": f"- node  n{e['node_id']}", "edge_added": "+ edge", "edge_invalidated": f"! edge  e{e['edge_id']}", "edge_superseded": "~ edge", "property_set": "P prop"}[e["kind"]]
    return f"{sign}  @{format_ns(e['at_ns'])}  (ev ev{e['event_id']})"


def render(result: Result) -> str:
    rows = result.rows.collect() if result.found else []
    if result.kind == "edges":
        return "".join(edge_line(e) + "\n" for e in rows) or "(no edges)\n"
    if result.kind == "path":
        return (path_line(rows) if result.found else "(no path)") + "\n"
    s = result.summary.first()
    head = f"summary: +{s.nodes_added} nodes, -{s.nodes_removed} nodes, +{s.edges_added} edges, !{s.edges_invalidated} invalidated, ~{s.edges_superseded} superseded\n"
    return head + "".join(entry_line(e) + "\n" for e in rows)


def edge_json(e) -> str:
    fields = {
        "id": e["edge_id"], "from": e["from_ext_id"], "to": e["to_ext_id"], "type": e["edge_type"], "valid_from": format_ns(e["valid_from_ns"]),
        "valid_to": None if e["valid_to_ns"] is None else format_ns(e["valid_to_ns"]), "observed_at": format_ns(e["observed_at_ns"]), "source": e["source"],
    }
    text = _dump(fields)[:-1] + f',"confidence":{single(e["confidence"])},"supersedes":{_dump(e["supersedes"])}'
    if e["props"]:
        text += ',"properties":' + _dump({k: _json_prop(v) for k, v in sorted(e["props"].items())})
    return text + "}"


def entry_json(e) -> str:
    fields = {"kind": e["kind"]}
    if e["kind"] == "node_removed":
        fields["node"] = e["node_id"]
    if e["kind"] == "edge_invalidated":
        fields["edge"] = e["edge_id"]
    return _dump(fields | {"at": format_ns(e["at_ns"]), "event": e["event_id"]})


def render_json(result: Result) -> str:
    rows = result.rows.collect() if result.found else []
    if result.kind == "edges":
        return f'{{"kind":"edges","count":{len(rows)},"edges":[{",".join(map(edge_json, rows))}]}}\n'
    if result.kind == "path":
        return f'{{"kind":"path","found":{_dump(result.found)},"edges":[{",".join(map(edge_json, rows))}]}}\n'
    return f'{{"kind":"diff","summary":{_dump(result.summary.first().asDict())},"entries":[{",".join(map(entry_json, rows))}]}}\n'


# ---------------------------------------------------------------- listings


def nodes_text(rows: Iterable) -> str:
    return "".join(f"{'n' + str(n['node_id']):<6} {n['ext_id']:<20} type={n['node_type'] or '-':<15} created={format_ns(n['created_at_ns'])}\n" for n in rows)


def nodes_json(rows: Iterable) -> str:
    return _dump([{"id": n["node_id"], "ext_id": n["ext_id"], "type": n["node_type"], "created_at": format_ns(n["created_at_ns"])} for n in rows]) + "\n"


def edges_text(rows: Iterable) -> str:
    return "".join(f"{'e' + str(e['edge_id']):<6} {e['from_ext_id']:<12} -[{e['edge_type']}]-> {e['to_ext_id']:<12} valid=[{format_ns(e['valid_from_ns'])}..{_end(e['valid_to_ns'])}) src={e['source'] or '-'} conf={e['confidence']:.2f}\n" for e in rows)


def edges_json(rows: Iterable) -> str:
    def one(e) -> str:
        fields = {"id": e["edge_id"], "from": e["from_ext_id"], "to": e["to_ext_id"], "type": e["edge_type"], "valid_from": format_ns(e["valid_from_ns"]), "valid_to": None if e["valid_to_ns"] is None else format_ns(e["valid_to_ns"]), "source": e["source"]}
        return _dump(fields)[:-1] + f',"confidence":{e["confidence"]:.4f}}}'

    return f"[{','.join(map(one, rows))}]\n"


def history_text(rows: Iterable) -> str:
    return "".join(f"{'→ ' if i == 0 else '  '}[e{e['edge_id']}] {e['from_ext_id']:<10} -[{e['edge_type']}]-> {e['to_ext_id']:<10}  valid_from={format_ns(e['valid_from_ns'])}  src={e['source'] or '-'}  conf={e['confidence']:.2f}\n" for i, e in enumerate(rows))


def dump_text(rows, total: int) -> str:
    """rows: any iterable of events; total: their number."""
    return f"events: {total}\n" + "".join(f"  [{'ev' + str(e['event_id']):>6}] @{format_ns(e['recorded_at_ns'])}  kind={EVENT_NAMES[e['kind']]}\n" for e in rows)
