"""Plain-Python model of the journey queries, and helpers to make small hit tables.

The model follows the queries as written: converters per (key, platform), first-visit rows per
(key, flag), both left joins with their repeated rows, then the drop of repeats.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from stepweave import schema


def hit(event_id, ts, user, event, session=1, platform="WEB", stream="s1", device=None, **params):
    """One hit; parameters by keyword, whole numbers go to the int slot."""
    bag = [] if session is None else [("ga_session_id", (None, session))]
    for key, value in params.items():
        bag.append((key, (None, value) if isinstance(value, int) else (value, None)))
    return (event_id, ts, user, event, platform, stream, (device,), bag, None)


def hits_table(spark, rows):
    return spark.createDataFrame(rows, schema.HITS)


def _param(row, key):
    return next((value[0] if value[0] is not None else value[1] for k, value in row[7] if k == key), None)


def journeys(rows, config, label):
    """Counter of (journey, flag) over keys; ``label`` maps a row to its content group."""
    conversion = config.conversion

    def key(row):
        session = _param(row, config.sessions.session_param)
        return None if row[2] is None or session is None else f"{row[2]}{config.sessions.separator}{session}"

    def flagged(row):
        texts = [value[0] for _, value in row[7] if value[0] is not None]
        if row[3] != conversion.event:
            return None
        if conversion.flag_value is not None:
            return conversion.flag_value if conversion.flag_value in texts else None
        found = [t for t in texts if re.search(conversion.flag_pattern, t)]
        return max(found) if found else None

    cutoff = {}
    for row in rows:
        if row[3] != conversion.event or key(row) is None:
            continue
        if conversion.streams is not None and row[5] not in conversion.streams:
            continue
        value = _param(row, conversion.param)
        if value is not None and re.search(conversion.cutoff_pattern, value):
            at = (key(row), row[4])
            cutoff[at] = min(cutoff.get(at, row[1]), row[1])
    by_key = defaultdict(list)
    for (k, _), time in cutoff.items():
        by_key[k].append(time)

    hits = [
        row
        for row in rows
        if (row[3] in config.events or flagged(row))
        and (config.hit_streams is None or row[5] in config.hit_streams)
        and key(row) is not None
    ]
    visits = {(key(row), int(row[3] == config.first_visit_event)) for row in hits}
    kept = defaultdict(list)
    for row in hits:
        k = key(row)
        for time in by_key.get(k) or [None]:
            for first_visit in [f for kk, f in visits if kk == k]:
                scope = config.first_visit_scope
                before = time is None or time >= row[1]
                keep = {
                    "none": before,
                    "converters": time is None or (time >= row[1] and first_visit == 0),
                    "all": before and first_visit == 0,
                    "exclude": before and (k, 1) not in visits,
                }[scope]
                if keep:
                    kept[k].append(row)
    out = Counter()
    for k, copies in kept.items():
        steps, flag, last = [], False, None
        for row in sorted(copies, key=lambda r: (r[1], r[0])):
            group = label(row)
            if group is None:
                continue
            if group != last:
                steps.append(group)
                flag = flag or flagged(row) is not None
            last = group
        if steps:
            out[(config.step_separator.join(steps), flag)] += 1
    return out


def counted(df):
    return Counter({(r.journey, r.conversion_flg): r.counts for r in df.collect()})
