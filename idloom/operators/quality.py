"""Photo quality: threshold checks in a fixed order, their summary, a frame's score, and the best of a burst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idloom import dims
from idloom.functions.numeric import clamp01, round_half_up

CHECK = "struct<key:string,passed:boolean,status:string,value:string,hint:string>"


def threshold_rules(profile: dict | None = None, live: Column | bool = False) -> list[tuple[str, Column, Column, Column, Column]]:
    """(key, whether it applies, whether it is met, measured value, hint) in the order of evaluation."""
    p = dims.PROFILE | (profile or {})
    live = F.lit(live) if isinstance(live, bool) else live
    c = F.col
    located, imaged = c("fill").isNotNull(), c("sharpness").isNotNull()
    hint = F.lit
    sharp = F.when(live, F.lit(p["minSharpnessLive"])).otherwise(F.lit(p["minSharpness"]))
    return [
        ("document_found", F.lit(True), located, F.when(located, F.lit("located")).otherwise("missing"), hint("find_document")),
        ("document_inside", located, c("margin") >= p["edgeMargin"], c("margin"), hint("show_whole_document")),
        ("document_fill", located, c("fill").between(p["minFill"], p["maxFill"]), c("fill"), F.when(c("fill") < p["minFill"], "move_closer").otherwise("move_back")),
        ("aspect_ratio", located, c("aspect_error") <= p["aspectTolerance"], c("aspect_error"), hint("wrong_document")),
        ("perspective", located, (c("angle_deviation") <= p["maxAngleDeviation"]) & (c("side_ratio") <= p["maxSideRatio"]), c("angle_deviation"), hint("hold_parallel")),
        ("resolution", located, c("dpi") >= p["minDpi"], c("dpi"), hint("move_closer")),
        ("stability", live & c("corner_motion").isNotNull(), c("corner_motion") <= p["maxCornerMotion"], c("corner_motion"), hint("hold_still")),
        ("sharpness", imaged, c("sharpness") >= sharp, c("sharpness"), hint("focus")),
        ("motion_blur", imaged, c("motion_isotropy") >= p["minMotionIsotropy"], c("motion_isotropy"), hint("hold_still")),
        ("focus_uniformity", imaged, c("focus_uniformity") >= p["minFocusUniformity"], c("focus_uniformity"), hint("hold_parallel")),
        ("exposure", imaged, c("paper").between(p["exposureMin"], p["exposureMax"]), c("paper"), F.when(c("paper") < p["exposureMin"], "more_light").otherwise("less_light")),
        ("highlights", imaged, c("highlight_clip") <= p["maxHighlightClip"], c("highlight_clip"), hint("less_light")),
        ("shadows_clipped", imaged, c("shadow_clip") <= p["maxShadowClip"], c("shadow_clip"), hint("more_light")),
        ("contrast", imaged, c("contrast") >= p["minContrast"], c("contrast"), hint("more_light")),
        ("glare", imaged, (c("glare_ratio") <= p["maxGlareRatio"]) & (c("glare_blob") <= p["maxGlareBlob"]), F.concat_ws(" · ", round_half_up(c("glare_ratio"), 4), round_half_up(c("glare_blob"), 4)), hint("avoid_glare")),
        ("color_glare", imaged, c("color_glare_ratio") <= p["maxColorGlareRatio"], c("color_glare_ratio"), hint("avoid_glare")),
        ("illumination", imaged, c("illumination") >= p["minIllumination"], c("illumination"), hint("even_light")),
        ("noise", imaged, c("noise") <= p["maxNoise"], c("noise"), hint("more_light")),
    ]


def build_checks(rules: list[tuple[str, Column, Column, Column, Column]], severity: dict[str, str]) -> Column:
    """An array of checks from rules; rules that don't apply or are off give none."""
    out = []
    for key, applies, met, value, hint in rules:
        level = severity[key]
        if level == "off":
            continue
        met = F.coalesce(met, F.lit(False))
        shown = value if key in ("document_found", "glare") else round_half_up(value, 4)
        status = F.when(met, "pass").otherwise("fail" if level == "block" else "warn")
        check = F.struct(F.lit(key).alias("key"), met.alias("passed"), status.alias("status"), shown.cast("string").alias("value"), hint.alias("hint"))
        out.append(F.when(applies, check.cast(CHECK)))
    return F.array_compact(F.array(*out)) if out else F.array().cast(f"array<{CHECK}>")


def summarise(checks: Column) -> list[Column]:
    """passed, flawless and the hint of the first blocking check, else of the first warning, else ``ready``."""
    failed, warned = F.filter(checks, lambda c: c["status"] == "fail"), F.filter(checks, lambda c: c["status"] == "warn")
    hint = F.coalesce(F.get(failed, 0)["hint"], F.get(warned, 0)["hint"], F.lit("ready"))
    return [(F.size(failed) == 0).alias("passed"), ((F.size(failed) == 0) & (F.size(warned) == 0)).alias("flawless"), hint.alias("hint")]


def frame_score(profile: dict | None = None, live: Column | bool = False) -> Column:
    """0.45 sharpness + 0.15 exposure + 0.15 freedom from glare + 0.25 even light, each 0 to 1; 0 without an image."""
    p = dims.PROFILE | (profile or {})
    live = F.lit(live) if isinstance(live, bool) else live
    low, high = p["exposureMin"], p["exposureMax"]
    sharp = F.when(live, F.lit(max(1.0, 3 * p["minSharpnessLive"]))).otherwise(F.lit(max(1.0, 3 * p["minSharpness"])))
    score = 0.45 * clamp01(F.col("sharpness") / sharp) + 0.15 * clamp01(1 - F.abs(F.col("paper") - (low + high) / 2) / max(1.0, (high - low) / 2))
    score = score + 0.15 * clamp01(1 - F.col("glare_ratio") / max(0.0001, 2 * p["maxGlareRatio"])) + 0.25 * clamp01(F.col("illumination"))
    return F.when(F.col("sharpness").isNull(), F.lit(0.0)).otherwise(round_half_up(score, 4))


def evaluate(frames: DataFrame, profile: dict | None = None, severity: dict | None = None, live: Column | bool = False) -> DataFrame:
    """``frames`` with checks, passed, flawless, hint and score."""
    with_checks = frames.withColumn("checks", build_checks(threshold_rules(profile, live), dims.SEVERITY | (severity or {})))
    return with_checks.select("*", *summarise(F.col("checks")), frame_score(profile, live).alias("score"))


def status_columns(profile: dict | None = None, severity: dict | None = None, live: Column | bool = False) -> dict[str, tuple[Column, Column]]:
    """(status, hint) of each check as plain columns, the status null where the check doesn't apply: what ``evaluate`` puts
    into its array, for reports over many frames that need neither values nor structs."""
    out, levels = {}, dims.SEVERITY | (severity or {})
    for key, applies, met, _, hint in threshold_rules(profile, live):
        if levels[key] != "off":
            bad = "fail" if levels[key] == "block" else "warn"
            out[key] = F.when(applies, F.when(F.coalesce(met, F.lit(False)), "pass").otherwise(bad)), hint
    return out


def evaluate_flat(frames: DataFrame, profile: dict | None = None, severity: dict | None = None, live: Column | bool = False) -> DataFrame:
    """``frames`` with a column ``status_<check>`` for each check, passed, flawless, hint, score, and ``first_hint``, that of
    the first check that isn't met. All of it is generated code over plain columns."""
    columns = status_columns(profile, severity, live)
    rows = frames.select("*", *[status.alias(f"status_{k}") for k, (status, _) in columns.items()])
    s = {k: F.col(f"status_{k}") for k in columns}
    never = F.lit(False)
    has = lambda bad: F.coalesce(F.greatest(never, *[F.coalesce(c == bad, never) for c in s.values()]), never)
    first = lambda *bad: [F.when(s[k].isin(*bad), hint) for k, (_, hint) in columns.items()]
    failed, warned = has("fail"), has("warn")
    hint = F.coalesce(*first("fail"), *first("warn"), F.lit("ready"))
    return rows.select("*", (~failed).alias("passed"), (~failed & ~warned).alias("flawless"), hint.alias("hint"), F.coalesce(*first("fail", "warn"), F.lit(None).cast("string")).alias("first_hint"), frame_score(profile, live).alias("score"))


def status_counts(frames: DataFrame, profile: dict | None = None, severity: dict | None = None, live: Column | bool = False) -> DataFrame:
    """(check_id, status, n): how often each check of the frames has each status, in one aggregation of a single row."""
    columns = status_columns(profile, severity, live)
    kinds = ("pass", "fail", "warn")
    counted = frames.select(*[c.alias(k) for k, (c, _) in columns.items()]).agg(*[F.count_if(F.col(k) == v).alias(f"{k}|{v}") for k in columns for v in kinds])
    entries = F.array(*[F.struct(F.lit(k).alias("check_id"), F.lit(v).alias("status"), F.col(f"`{k}|{v}`").alias("n")) for k in columns for v in kinds])
    return counted.select(F.explode(entries).alias("e")).select("e.*").where("n > 0")


def message_of(hint: Column) -> Column:
    """What a hint tells the person who holds the camera."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in dims.HINTS.items() for x in kv]), hint)


def gate(mode: str, checks: Column) -> Column:
    """An enforcing gate lets nothing with a blocking failure pass; any other mode lets everything pass."""
    return F.lit(True) if mode != "enforce" else ~F.exists(checks, lambda c: c["status"] == "fail")


def zone_checks(zones: DataFrame, *keys: str) -> DataFrame:
    """Four check rows for each required zone from its measured shares: visible, sharpness, glare, exposure."""
    ok = {
        "visible": F.col("visible"),
        "sharpness": F.col("zone_sharpness") >= F.col("min_sharpness"),
        "glare": F.col("zone_glare") <= F.col("max_glare"),
        "exposure": F.col("zone_paper").between(F.col("min_paper"), F.col("max_paper")),
    }
    rows = F.array(*[F.struct(F.concat(F.lit(f"zone_{k}."), F.col("zone_id")).alias("check_id"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in ok.items()])
    return zones.where("required").select(*keys, F.explode(rows).alias("_c")).select(*keys, "_c.*")


def best_frame(frames: DataFrame, *keys: str) -> DataFrame:
    """The best frame of each burst: passed before failed, then the highest score, then the earliest."""
    order = Window.partitionBy(*keys).orderBy(F.desc("passed"), F.desc("score"), "pos")
    return frames.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def profile_faults(profile: Column) -> Column:
    """Names of the parts of a profile (JSON text) that are missing, of a wrong kind, out of range or out of order. The text
    is parsed once, every part as text."""
    groups: dict[str, list[str]] = {"severity": list(dims.SEVERITY)}
    for path in [b[0] for b in dims.PROFILE_BOUNDS] + list(dims.PROFILE_SWITCHES):
        group, _, name = path.partition(".")
        groups.setdefault(group, []).append(name)
    schema = ", ".join(["version string", "mode string"] + [f"{g} struct<{','.join(f'{n}: string' for n in names)}>" for g, names in groups.items()])
    return F.get(F.transform(F.array(F.from_json(profile, schema)), _faults), 0)


def _faults(parsed: Column) -> Column:
    def part(path: str) -> Column:
        group, _, name = path.partition(".")
        return parsed[group][name] if name else parsed[group]

    out = []
    for path, low, high, whole, default in dims.PROFILE_BOUNDS:
        value = part(path).try_cast("double")
        good = value.between(low, high) & ((value == F.floor(value)) if whole else F.lit(True))
        good = F.coalesce(good, F.lit(False))
        out.append(F.when(~((part(path).isNull() | good) if default else good), F.lit(path)))
    out += [F.when(~F.coalesce(part(f).isin("true", "false"), F.lit(False)), F.lit(f)) for f in dims.PROFILE_SWITCHES]
    for key in dims.SEVERITY:
        known = part(f"severity.{key}").isin("block", "warn", "off")
        out.append(F.when(~F.coalesce(known, F.lit(key == "color_glare") & part(f"severity.{key}").isNull()), F.lit(f"severity.{key}")))
    out += [F.when(~F.coalesce(part("version") == "2", F.lit(False)), F.lit("version")), F.when(~F.coalesce(part("mode").isin("off", "observe", "enforce"), F.lit(False)), F.lit("mode"))]
    for low, high in dims.PROFILE_ORDER:
        out.append(F.when(part(low).try_cast("double") >= part(high).try_cast("double"), F.lit(f"{low}>={high}")))
    return F.array_compact(F.array(*out))


def profile_problems(profile: dict) -> list[str]:
    """Names of the flat limits of one profile that are out of range or out of order; missing ones take their default."""
    p = dims.PROFILE | profile
    bounds = {path.partition(".")[2]: (low, high) for path, low, high, _, _ in dims.PROFILE_BOUNDS if path.startswith(("capture.max", "document.", "image."))}
    bad = [name for name, value in p.items() if not bounds[name][0] <= value <= bounds[name][1]]
    return bad + [f"{a}>{b}" for a, b in (("minFill", "maxFill"), ("exposureMin", "exposureMax")) if p[a] >= p[b]]


def report_checks(checks: Column, duration_ms: Column | float = 0.0) -> Column:
    """Checks of a frame in the form of a report: each with the message of its hint and the time that it took."""
    message = F.create_map(*[F.lit(x) for kv in dims.HINTS.items() for x in kv])
    took = F.lit(duration_ms) if isinstance(duration_ms, float) else duration_ms
    return F.transform(checks, lambda c: F.struct(c["key"].alias("key"), c["passed"].alias("passed"), c["status"].alias("status"), c["value"].alias("value"), F.element_at(message, c["hint"]).alias("message"), c["hint"].alias("hint"), took.alias("duration_ms")))


def calibration_snapshot(sessions: DataFrame, buffers: tuple[str, ...] = ("listeners", "latest_image", "capture_original", "capture_ocr")) -> DataFrame:
    """Calibration sessions without listeners and image buffers."""
    return sessions.drop(*buffers)


def upgrade_profile(saved: dict) -> dict:
    """A saved profile with the limits that it lacks; from version 1 only the mode is kept."""
    if saved.get("version", 1) < 2:
        return {"version": 2, "mode": saved.get("mode", "observe"), "limits": dict(dims.PROFILE)}
    return {"version": 2, "mode": saved.get("mode", "observe"), "limits": dims.PROFILE | saved.get("limits", {})}


def telemetry(frames: DataFrame, *keys: str) -> DataFrame:
    """A compact report of evaluated frames: score, verdict, hint and the status of each check."""
    checks = F.map_from_entries(F.transform("checks", lambda c: F.struct(c["key"], c["status"])))
    n = lambda status: F.size(F.filter("checks", lambda c: c["status"] == status)).cast("long")
    return frames.select(*keys, "score", "passed", "hint", checks.alias("checks"), n("pass").alias("met"), n("fail").alias("failed"), n("warn").alias("warned"))


def read_limit(profile: dict, path: str):
    """A profile's value by its dotted path, or None."""
    for part in path.split("."):
        profile = profile.get(part) if isinstance(profile, dict) else None
    return profile


def write_limit(profile: dict, path: str, value) -> dict:
    """A copy of the profile with the value at a dotted path replaced."""
    head, _, rest = path.partition(".")
    return profile | {head: write_limit(profile.get(head, {}), rest, value) if rest else value}
