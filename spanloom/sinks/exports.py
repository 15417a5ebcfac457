"""Exports: JSON, CSV and text reports of clips, and export plans as rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import scoring
from spanloom.functions import text as T
from spanloom.operators import camera

#: Columns of the CSV export, in order, and export padding in seconds (fixed values).
CSV_COLUMNS = ["rank", "start", "end", "start_tc", "end_tc", "duration", "score", "type", "title", "reason", *scoring.SCORE_KEYS]
PAD = (0.15, 0.35)


def _shown(v: Column, digits: int) -> Column:
    """Rounded, with no trailing zeros but one."""
    return F.round(v, digits).cast("string")


def report_rows(clips: DataFrame) -> DataFrame:
    """Clips in the export's form: times at 2 digits, scores at 1, time codes, reason on one line."""
    d = clips.withColumns({"score": F.round("overall", 1), "type": F.col("clip_type"), "duration": F.round(F.col("end") - F.col("start"), 2), "start_tc": T.fmt_ts(F.col("start")), "end_tc": T.fmt_ts(F.col("end"))})
    d = d.withColumns({"start": F.round("start", 2), "end": F.round("end", 2), "reason": F.array_join(T.words(F.coalesce("reason", F.lit(""))), " ")})
    return d.withColumns({k: F.round(k, 1) for k in scoring.SCORE_KEYS})


def csv_rows(clips: DataFrame) -> DataFrame:
    return report_rows(clips).select("transcript_id", *CSV_COLUMNS)


def json_rows(clips: DataFrame) -> DataFrame:
    """(transcript_id, json): the clips of a transcript by rank."""
    d = report_rows(clips)
    c = F.struct("rank", "start", "end", "duration", "start_tc", "end_tc", "score", F.struct(*scoring.SCORE_KEYS).alias("scores"), "confidence", "type", "title", "reason", F.col("text").alias("transcript"))
    g = d.groupBy("transcript_id").agg(F.array_sort(F.collect_list(c)).alias("clips"))
    return g.select("transcript_id", F.to_json(F.struct(F.col("transcript_id").alias("video"), "clips")).alias("json"))


def text_rows(clips: DataFrame, white: T.White = T.UNICODE) -> DataFrame:
    """(transcript_id, rank, report): one block of lines for each clip."""
    d = report_rows(clips)
    s = lambda c: F.col(c).cast("string")
    cats = F.concat_ws(" | ", *[F.concat(F.lit(k.capitalize() + " "), s(k), F.lit(f"/{int(cap)}")) for k, cap in scoring.CATEGORY_MAX.items()])
    lines = [
        F.concat(F.lit("#"), s("rank"), F.lit(" - "), s("score"), F.lit("/100   ["), F.col("type"), F.lit("]")),
        F.concat(F.col("start_tc"), F.lit(" -> "), F.col("end_tc"), F.lit("   ("), s("duration"), F.lit("s)")),
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit(""))),
        cats,
        F.concat(F.lit("Why: "), F.col("reason")),
        F.lit("Transcript:"),
        F.concat(F.lit("  "), F.array_join(T.words(F.coalesce("text", F.lit("")), white), " ")),
        F.lit("-" * 66),
    ]
    return d.select("transcript_id", "rank", F.concat_ws("\n", *lines).alias("report"))


def write_reports(clips: DataFrame, path: str, names: DataFrame | None = None, at: Column | None = None) -> None:
    """CSV, JSON lines and text under one folder, each partitioned by transcript: a rerun replaces its own transcripts and no other.

    With names (transcript_id, filename) a transcript's folder has one for each export, named by `stem` from the file's
    name without its extension and the time `at` (now): earlier exports stay.  A transcript without a name is `clips`.
    """
    by = ["transcript_id"] + ([] if names is None else ["export"])
    if names is not None:
        base = F.regexp_replace(F.regexp_extract(F.coalesce("filename", F.lit("clips")), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
        label = names.groupBy("transcript_id").agg(F.min("filename").alias("filename")).select("transcript_id", stem(base, F.current_timestamp() if at is None else at).alias("export"))
        none = stem(F.lit("clips"), F.current_timestamp() if at is None else at)

    def put(d: DataFrame):
        if names is not None:
            d = d.join(label, "transcript_id", "left").withColumn("export", F.coalesce("export", none))
        return d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)

    put(csv_rows(clips)).option("header", True).csv(f"{path}/csv")
    put(json_rows(clips)).text(f"{path}/json")
    put(text_rows(clips).select("transcript_id", F.col("report").alias("value"))).text(f"{path}/txt")


def csv_document(clips: DataFrame) -> DataFrame:
    """(transcript_id, csv): the whole CSV file of a transcript as spreadsheets read it, byte order mark and header first, a line for each clip."""
    cells = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), '"', '""') for c in CSV_COLUMNS]
    line = F.array_join(F.array(*[F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c) for c in cells]), ",")
    d = csv_rows(clips).select("transcript_id", F.struct("rank", line.alias("line")).alias("r")).groupBy("transcript_id").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return d.select("transcript_id", F.concat(F.lit("\ufeff" + ",".join(CSV_COLUMNS) + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n")).alias("csv"))


def stem(name: Column, at: Column) -> Column:
    """Stem of a transcript's export files: its name and the time of the export."""
    return F.concat(T.safe_stem(name), F.lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def clear_cache(spark, root: str, name: str | None = None, reserved=("models", "thumbs")) -> list[str]:
    """Delete one folder under a cache root, or all but the reserved ones; the names that went."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(top) if s.isDirectory() and s.getPath().getName() not in reserved] if fs.exists(top) else []
    gone = [p for p in there if name is None or p.getName() == name]
    return sorted(p.getName() for p in gone if fs.delete(p, True))


def cache_folder(path: str, model: str, language: str | None = None) -> str:
    """Folder of the transcripts that a model made for a language; other models, languages and versions have their own."""
    safe = re.sub(r"[^\w.-]", "_", f"{model}_{language or 'auto'}")
    return f"{path}/transcript_v2_{safe}"


def write_cache(transcripts: DataFrame, path: str, model: str | None = None, language: str | None = None) -> None:
    """One partition a transcript; a rerun replaces only the transcripts it holds, and those without words are never cached.

    With a model, under its `cache_folder`.
    """
    at = path if model is None else cache_folder(path, model, language)
    transcripts.where(F.size("words") > 0).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("transcript_id").parquet(at)


def plan_clips(clips: DataFrame, durations: DataFrame, formats=("16:9",), src: tuple[int, int] = (1920, 1080), burn: bool = False, overlay: bool = False, white: T.White = T.UNICODE) -> DataFrame:
    """A row for each clip and format: padded times within the recording, output name, and whether a stream copy will do."""
    wanted = [f for f in dict.fromkeys(formats) if f in camera.FORMATS] or ["16:9"]
    d = clips.join(durations.select("transcript_id", F.col("duration").alias("_d")), "transcript_id", "left")
    d = d.withColumns({"cut_start": F.greatest(F.lit(0.0), F.col("start") - PAD[0]), "cut_end": F.when(F.col("_d") > 0, F.least(F.col("end") + PAD[1], F.col("_d"))).otherwise(F.col("end") + PAD[1])})
    d = d.withColumn("format", F.explode(F.array(*[F.lit(f) for f in wanted])))
    native = (F.col("format") == "16:9") & F.lit(abs(src[0] / src[1] - 16 / 9) < 0.02)
    name = F.concat(F.lit("clip_"), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("_"), T.safe_stem(F.coalesce("title", F.lit("")), 40, white), F.lit("_"), F.replace("format", F.lit(":"), F.lit("x")), F.lit(".mp4"))
    return d.withColumns({"file": name, "stream_copy": native & F.lit(not burn and not overlay)}).drop("_d")


def cut_command(source: Column, start: Column, end: Column, out: Column, copy: Column) -> Column:
    """Argument vector of a cut: stream copy or re-encode."""
    t = lambda c: F.format_string("%.3f", c)
    head = F.array(F.lit("ffmpeg"), F.lit("-y"), F.lit("-ss"), t(start), F.lit("-i"), source, F.lit("-t"), t(end - start))
    how = F.when(copy, F.array(F.lit("-c"), F.lit("copy"), F.lit("-avoid_negative_ts"), F.lit("make_zero"))).otherwise(F.array(*[F.lit(x) for x in ("-c:v", "libx264", "-preset", "veryfast", "-crf", "20", "-c:a", "aac")]))
    return F.concat(head, how, F.array(out))


def plan_compilation(clips: DataFrame, group: str, order: str) -> DataFrame:
    """Spans of a compilation in order, with the offset of each into the whole (and so into its music)."""
    d = clips.withColumns({"cut_start": F.greatest(F.lit(0.0), F.col("start") - PAD[0]), "cut_end": F.col("end") + PAD[1]})
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return d.withColumn("music_offset", F.coalesce(F.sum(F.col("cut_end") - F.col("cut_start")).over(w), F.lit(0.0)))


# Filter names, labels and options in the next functions are fixed values: they are another program's interface.


def music_graph(duration: float, input_index: int, volume: float = 0.15, fade: float = 0.6, offset: float = 0.0, fade_in: bool = True, fade_out: bool = True) -> str:
    """Filter fragment that mixes a looped, faded track under the first audio stream into [aout]."""
    duration = max(0.05, duration)
    fade = min(max(0.0, min(2.0, fade)), max(0.02, duration / 2 - 0.02))
    bed = [f"[{input_index}:a]aloop=loop=-1:size=2e9", f"atrim=start={offset:.3f}:end={offset + duration:.3f}", "asetpts=PTS-STARTPTS"]
    bed += [f"afade=t=in:st=0:d={fade:.3f}"] * fade_in + [f"afade=t=out:st={max(0.0, duration - fade):.3f}:d={fade:.3f}"] * fade_out
    return f"[0:a]volume=1.0[amain];{','.join(bed)},volume={max(0.0, min(1.0, volume)):.3f}[amus];[amain][amus]amix=inputs=2:duration=first:dropout_transition=0:normalize=0[aout]"


#: Overlay positions: x and y, M for the margin (fixed values).
CORNERS = {"top_left": ("M", "M"), "top_right": ("W-w-M", "M"), "bottom_left": ("M", "H-h-M"), "bottom_right": ("W-w-M", "H-h-M"), "center": ("(W-w)/2", "(H-h)/2")}


def video_filter(src: tuple[int, int], fmt: str, segs=(), layout: str = "crop", subtitle: str | None = None, watermark: dict | None = None) -> str:
    """The filter chain of one clip: crop or blurred fit, scale, subtitles last; with a watermark a graph that ends in [vout]."""
    (sw, sh), (w, h) = src, camera.FORMATS.get(fmt, camera.FORMATS["9:16"])
    shape, target = sw / sh, w / h
    even = lambda v, most: min(most, max(2, round(v)) // 2 * 2)
    if layout == "fit_blur":
        steps = [f"split=2[bg][fg];[bg]scale={w}:{h}:force_original_aspect_ratio=increase,crop={w}:{h},gblur=sigma=28[bgb];[fg]scale={w}:{h}:force_original_aspect_ratio=decrease[fgs];[bgb][fgs]overlay=(W-w)/2:(H-h)/2"]
    elif abs(shape - target) < 0.02:
        steps = [f"scale={w}:{h}"]
    elif shape > target:
        cw = even(sh * target, sw)
        x = f"'{camera.crop_expression(list(segs), sw, cw)}'" if segs else f"(iw-{cw})/2"
        steps = [f"crop={cw}:{sh}:x={x}:y=0", f"scale={w}:{h}"]
    else:
        ch = even(sw / target, sh)
        steps = [f"crop={sw}:{ch}:x=0:y=(ih-{ch})*0.35", f"scale={w}:{h}"]
    chain = ",".join([*steps, "setsar=1", *([f"subtitles={subtitle}"] if subtitle else [])])
    if not watermark:
        return chain
    size = lambda k, d, lo, hi: max(lo, min(hi, float(watermark.get(k, d) or d)))
    margin = str(max(0, round(min(w, h) * size("margin", 0.04, 0.0, 0.4))))
    x, y = (p.replace("M", margin) for p in CORNERS.get(watermark.get("position", "top_right"), CORNERS["top_right"]))
    return f"[0:v]{chain}[base];[1:v]scale={max(2, round(w * size('scale', 0.18, 0.02, 0.9)))}:-1,format=rgba,colorchannelmixer=aa={size('opacity', 0.85, 0.05, 1.0):.3f}[wm];[base][wm]overlay=x={x}:y={y}:format=auto[vout]"


# ---- command plans ------------------------------------------------------------------
# Argument vectors, formats and switches are fixed values: they are another program's interface.

QUIET = ("ffmpeg", "-y", "-hide_banner", "-loglevel", "error")
ENCODERS = {"nvenc": ("-c:v", "h264_nvenc", "-preset", "p4", "-rc", "vbr", "-cq", "23", "-b:v", "0", "-pix_fmt", "yuv420p"), "cpu": ("-c:v", "libx264", "-preset", "veryfast", "-crf", "21", "-pix_fmt", "yuv420p")}
SOUND = ("-c:a", "aac", "-b:a", "192k", "-movflags", "+faststart")


def _argv(*parts) -> Column:
    """One array of literals (str) and columns."""
    return F.array(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _seconds(c: Column) -> Column:
    return F.format_string("%.3f", F.greatest(F.lit(0.0), c.cast("double")))


def audio_command(source: Column, out: Column, rate: int = 16000) -> Column:
    """Mono PCM of the first audio stream."""
    return _argv(*QUIET, "-i", source, "-vn", "-sn", "-dn", "-ac", "1", "-ar", str(rate), "-acodec", "pcm_s16le", "-map", "0:a:0?", out)


def concat_list(files: Column) -> Column:
    """The list file of a concatenation."""
    return F.array_join(F.transform(files, lambda f: F.concat(F.lit("file '"), f, F.lit("'"))), "\n")


def concat_command(list_file: Column, out: Column, encoder: str | None = None) -> Column:
    """Join segments by stream copy, or by encoding them anew."""
    how = ("-c", "copy", "-movflags", "+faststart") if encoder is None else (*ENCODERS[encoder], *SOUND)
    return _argv(*QUIET, "-f", "concat", "-safe", "0", "-i", list_file, *how, out)


def render_command(source: Column, start: Column, end: Column, graph: Column, out: Column, inputs: tuple = (), labelled: bool = False, sound: str = "0:a?", encoder: str = "cpu") -> Column:
    """Encode a span through a filter chain, or a labelled graph that ends in [vout]; at least 0.2 s."""
    more = [x for i in inputs for x in ("-i", i)]
    how = ("-filter_complex", graph, "-map", "[vout]", "-map", sound) if labelled else ("-vf", graph)
    return _argv(*QUIET, "-ss", _seconds(start), "-i", source, *more, "-t", _seconds(F.greatest(F.lit(0.2), end - start)), *how, *ENCODERS[encoder], *SOUND, out)


def burn_command(source: Column, start: Column, end: Column, subtitle: Column, out: Column, fonts: str | None = None, encoder: str = "cpu") -> Column:
    """Encode a span with a subtitle file burnt in."""
    return render_command(source, start, end, F.concat(F.lit("subtitles="), subtitle, F.lit(f":fontsdir={fonts}" if fonts else "")), out, encoder=encoder)


def frame_command(source: Column, at: Column, out: Column, graph: Column | None = None) -> Column:
    """One frame, through a filter chain if there is one."""
    return _argv(*QUIET, "-ss", _seconds(at), "-i", source, *(() if graph is None else ("-vf", graph)), "-frames:v", "1", "-q:v", "2", out)


def thumbnail_command(source: Column, at: Column, out: Column, width: int = 480) -> Column:
    return _argv(*QUIET, "-ss", _seconds(at), "-i", source, "-frames:v", "1", "-vf", f"scale={width}:-2", out)


# ---- metadata text ------------------------------------------------------------------

#: The closing section of a metadata file (fixed value: the text must equal the established one).
TIPS = (
    "ALGORITHM TIPS", "-" * 66,
    "- Post the hook frame first - no logo/intro before the payoff starts.",
    "- Reply to the first comments within the first hour; early replies signal",
    "  the algorithm to keep pushing the clip.",
    "- TikTok/Reels: completion rate and rewatches matter more than likes -",
    "  this clip's boundaries were already trimmed to open and close tight.",
    "- Post consistently rather than chasing perfect timing; the account's",
    "  posting cadence matters more than the hour of the day.",
    "",
)


def metadata_text(clips: DataFrame) -> DataFrame:
    """clips (rank, title, start, end, metadata as JSON) with `file` and `body`: the metadata text of each clip that has metadata."""
    d = clips.where(F.col("metadata").isNotNull())
    word = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}"), F.lit(""))
    listed = lambda k, sep: F.array_join(F.coalesce(F.from_json(F.get_json_object("metadata", f"$.{k}"), "array<string>"), F.array().cast("array<string>")), sep)
    title, rule = F.coalesce("title", F.lit("")), F.lit("-" * 66)
    head = F.concat(F.lit("CLIP #"), F.col("rank").cast("string"), F.lit(" — "), title)
    times = F.concat(T.fmt_ts(F.col("start")), F.lit(" -> "), T.fmt_ts(F.col("end")), F.lit("  ("), F.bround(F.col("end") - F.col("start")).cast("long").cast("string"), F.lit("s)"))
    lines = [head, times, F.lit("=" * 66), F.lit("")]
    lines += [F.lit("YOUTUBE"), rule, F.concat(F.lit("Title: "), word("youtube_title")), F.lit("Description:"), word("youtube_description"), F.concat(F.lit("Tags: "), listed("youtube_tags", ", ")), F.lit("")]
    for name in ("tiktok", "instagram"):
        lines += [F.lit(name.upper()), rule, F.lit("Description:"), word(f"{name}_description"), F.concat(F.lit("Hashtags: "), listed(f"{name}_hashtags", " ")), F.lit("")]
    mentions = listed("mentions", ", ")
    asked = F.when(mentions != "", F.array(F.lit("MENTIONS (required by the campaign brief)"), rule, mentions, F.lit(""))).otherwise(F.array().cast("array<string>"))
    body = F.array_join(F.concat(F.array(*lines), asked, F.array(*[F.lit(x) for x in TIPS])), "\n")
    name = F.concat(F.lit("clip_"), F.lpad(F.col("rank").cast("string"), 2, "0"), F.lit("_"), F.when(F.trim(title) != "", T.safe_stem(F.trim(title), 40)).otherwise(F.col("clip_type")), F.lit("_metadata.txt"))
    return d.withColumns({"file": name, "body": body})
