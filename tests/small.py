"""A hand-made archive for tests: few rows, invented names."""

from podium import schema

COLUMNS = {t: schema.columns(t) for t in schema._DDL}


def catalog(spark, **rows):
    """Tables from dicts of values; what isn't given is null."""
    out = {}
    for t in schema._DDL:
        given = [tuple(r.get(c) for c in COLUMNS[t]) for r in rows.get(t, [])]
        out[t] = spark.createDataFrame(given, schema.ddl(t).replace(" NOT NULL", ""))
    return out


def meet(spark, results, entries=None, **more):
    """One competition per ``comp`` of the results; each result is a dict with event, heat, round, rank, name and so on."""
    comps, events, rounds, heats, people, starts, found = {}, {}, {}, {}, {}, [], []
    for i, r in enumerate(results, 1):
        c = r.get("comp", 1)
        comps.setdefault(c, {"id": c, "name": f"대회{c}", "short_name": f"대{c}", "edition": r.get("edition", c), "start_date": r.get("date")})
        ek = (c, r.get("division", "남중부"), r.get("event", "500m"))
        e = events.setdefault(ek, {"id": len(events) + 1, "competition_id": c, "division_name": ek[1], "gender": "M", "event_name": ek[2], "team_event": "계주" in ek[2]})
        rk = (e["id"], r.get("round", "결승"))
        rd = rounds.setdefault(rk, {"id": len(rounds) + 1, "event_id": e["id"], "round": rk[1], "event_number": r.get("number", len(rounds) + 1), "day_number": 1})
        hk = (rd["id"], r.get("heat", 0))
        h = heats.setdefault(hk, {"id": len(heats) + 1, "event_round_id": rd["id"], "heat_number": hk[1]})
        pk = (c, r["name"], r.get("gender", "M"), r.get("team", "팀"), r.get("region", "경기"))
        p = people.setdefault(pk, {"id": len(people) + 1, "competition_id": c, "athlete_name": pk[1], "gender": pk[2], "team_name": pk[3], "region": pk[4], "athlete_id": r.get("athlete_id")})
        starts.append({"id": i, "heat_id": h["id"], "entry_id": p["id"], "bib_number": r.get("bib", i)})
        if r.get("result", True):
            found.append({"id": i, "heat_entry_id": i, "ranking": r.get("rank"), "record": r.get("record"), "new_record": r.get("mark")})
    tables = {"competition": list(comps.values()), "event": list(events.values()), "event_round": list(rounds.values()), "event_heat": list(heats.values()), "competition_entry": list(people.values()), "heat_entry": starts, "event_result": found}
    return catalog(spark, **(tables | more))


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
