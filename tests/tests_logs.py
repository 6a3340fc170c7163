"""Lines of log files for tests."""

import json


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def assistant(ident="r1", model="m-1", time="2024-05-01T10:00:00.123456Z", usage=None, **more):
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 7} if usage is None else usage
    return {"type": "assistant", "requestId": ident, "timestamp": time, "cwd": "/w", "gitBranch": "b", "message": {"model": model, "usage": usage}} | more


def block(i, c=0, w=0, o=0):
    return {"input_tokens": i, "cached_input_tokens": c, "cache_write_input_tokens": w, "output_tokens": o}


def tc(time, total=None, last=None, **payload):
    info = {k: v for k, v in (("total_token_usage", total), ("last_token_usage", last)) if v}
    return {"type": "event_msg", "timestamp": time, "payload": {"type": "token_count", "info": info} | payload}


def meta(ident="s", **more):
    return {"type": "session_meta", "payload": {"id": ident, "cwd": "/w", "git": {"branch": "b"}} | more}


def turn(ident="t", model="m", **more):
    return {"type": "turn_context", "payload": {"turn_id": ident, "model": model} | more}
