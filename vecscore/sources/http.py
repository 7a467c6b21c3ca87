"""A small HTTP client: JSON calls with a bearer token, time-outs, retries with back-off."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import uuid

#: The environment variable that holds the providers' token, on the driver and the executors.
TOKEN_VARIABLE = "VECSCORE_API_TOKEN"


def token() -> str:
    return os.environ.get(TOKEN_VARIABLE, "")


def call(url: str, body: bytes | None = None, kind: str = "application/json", timeout: float = 60, method: str | None = None, key: str | None = None) -> bytes:
    """One request; an answer of 400 or above raises with the body's beginning."""
    headers = {"Content-Type": kind} if body is not None else {}
    if key or token():
        headers["Authorization"] = f"Bearer {key or token()}"
    request = urllib.request.Request(url, data=body, headers=headers, method=method or ("POST" if body is not None else "GET"))
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()
    except urllib.error.HTTPError as error:
        raise OSError(f"HTTP {error.code}: {error.read()[:500].decode(errors='replace')}") from error


def post_json(url: str, value, timeout: float = 60):
    return json.loads(call(url, json.dumps(value).encode(), timeout=timeout))


def with_retry(run, retries: int = 3, sleep=time.sleep):
    """``run()``, tried ``retries`` times more, after 1, 2, 4, 8, 8, ... seconds."""
    for attempt in range(1, retries + 2):
        try:
            return run()
        except Exception as error:
            if attempt > retries:
                raise RuntimeError(f"given up after {attempt} attempts: {error}") from error
            sleep(min(2 ** (attempt - 1), 8))


def multipart(fields: dict[str, str], name: str, data: bytes) -> tuple[bytes, str]:
    """Body and content type of a form with one file."""
    mark = uuid.uuid4().hex
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="file"; filename="{name}"\r\nContent-Type: application/jsonl\r\n\r\n'.encode() + data + b"\r\n")
    return b"".join(parts) + f"--{mark}--\r\n".encode(), f"multipart/form-data; boundary={mark}"
