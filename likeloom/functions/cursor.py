"""Feed cursors: small state that a client carries from page to page. Plain Python, on the driver.

Text form: base64url without padding of raw-deflated JSON. Older forms are read: plain JSON in
base64url, a bare offset, and "eof" for a feed that is at its end.
"""

from __future__ import annotations

import base64
import json
import zlib
from dataclasses import asdict, dataclass, field, replace

END = "eof"


@dataclass(frozen=True)
class Cursor:
    offset: int = 0
    last_score: float | None = None
    last_post_id: int | None = None
    fallback_only: bool = False
    fallback_offset: int = 0
    shown_pinned: tuple[str, ...] = ()
    shown_rotating: tuple[str, ...] = ()
    shown_sponsored: tuple[str, ...] = ()
    shown_fallback: tuple[str, ...] = ()
    in_holdout: bool = False
    version: int = field(default=3, compare=False)

    @property
    def first_page(self) -> bool:
        return self.offset == 0 and self.fallback_offset == 0 and self.last_score is None

    @property
    def at_end(self) -> bool:
        return self.offset < 0


def encode(cursor: Cursor) -> str:
    if cursor.at_end:
        return END
    raw = json.dumps({k: v for k, v in asdict(cursor).items() if v not in (None, (), False, 0)}, separators=(",", ":")).encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return base64.urlsafe_b64encode(packer.compress(raw) + packer.flush()).rstrip(b"=").decode()


def decode(text: str | None) -> Cursor:
    """The cursor of a text; what can't be read is a first page."""
    if not text:
        return Cursor()
    if text == END:
        return Cursor(offset=-1)
    if text.isdigit():
        return Cursor(offset=int(text), version=0)
    try:
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        body = raw if raw[:1] == b"{" else zlib.decompress(raw, -15)
        found = json.loads(body)
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in found.items() if k in Cursor.__dataclass_fields__}
        return Cursor(**known)
    except (ValueError, TypeError, zlib.error):
        return Cursor()


def advanced(cursor: Cursor, shown: int, limit: int, fallback: list[str], holdout: bool = False) -> Cursor:
    """The cursor after a page. A page less than half full, or a holdout, goes on with the fallback lists alone."""
    if shown == 0:
        return Cursor(offset=-1)
    only = cursor.fallback_only or holdout or shown < limit / 2
    moved = replace(cursor, fallback_only=only, in_holdout=cursor.in_holdout or holdout)
    seen = tuple(dict.fromkeys((*cursor.shown_fallback, *fallback)))
    if only:
        return replace(moved, fallback_offset=cursor.fallback_offset + shown, offset=cursor.offset + shown, shown_fallback=seen)
    return replace(moved, offset=cursor.offset + shown)
