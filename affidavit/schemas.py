"""Schemas of the archive's tables."""

from __future__ import annotations

from pyspark.sql import types as T


STRING, INT, BOOLEAN, STRINGS = T.StringType(), T.IntegerType(), T.BooleanType(), T.ArrayType(T.StringType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


UNIT_META = _struct(
    t_start=INT, t_end=INT, meeting=STRING, phase=STRING, internal=BOOLEAN, unattributed_dialect=BOOLEAN, trails_off=BOOLEAN,
    subject=STRING, from_raw=STRING, attachments_stripped=INT, thread_position=INT, thread_total=INT, header_language=STRING,
)
UNITS = _struct(
    unit_id=STRING, doc_id=STRING, doc_kind=STRING, seq=INT, text=STRING, date_text=STRING, ts=T.TimestampNTZType(),
    speaker=STRING, speaker_display=STRING, speaker_org=STRING, recipients=STRINGS, locator=STRING, truncated=BOOLEAN,
    interrupted_by=STRINGS, spans_units=STRINGS, redacted=BOOLEAN, redaction_note=STRING, meta=UNIT_META,
)
DOCUMENT_META = _struct(short=STRING, dialect=STRING, declared_messages=INT, parsed_messages=INT, first_date=STRING)
DOCUMENTS = _struct(
    doc_id=STRING, kind=STRING, path=STRING, title=STRING, date_text=STRING, phase=STRING, participants=STRINGS, subject=STRING,
    n_units=INT, internal=BOOLEAN, meta=DOCUMENT_META,
)
PEOPLE = _struct(pid=STRING, display=STRING, org=STRING, role=STRING, emails=STRINGS, aliases=STRINGS, mention_only=BOOLEAN)
