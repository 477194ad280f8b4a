"""Texts shown for values, and classes of messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks an EXIF line as important, and messages as errors of the GPU.
EXIF_PHRASES = (
    "image width", "image height", "image size", "pixel dimensions", "megapixels", "resolution", "bit depth", "bitdepth", "bits per sample",
    "bits per pixel", "date/time original", "create date", "creation date", "date created", "modify date", "modification date", "date modified",
)
GPU_MARKERS = (
    "cuda", "cublas", "cudnn", "nvidia", "gpu", "device-side assert", "illegal memory access", "driver shutting down",
    "driver initialization failed", "unspecified launch failure", "out of memory",
)
# Names of models that mean the default one, and what the names of models on a hub begin with.
DEFAULT_CLIP = "hf-hub:timm/ViT-L-16-SigLIP2-384"
CLIP_ALIASES = ("clip-ViT-L-16-SigLIP2-384", "ViT-L-16-SigLIP2-384")
HUB_OWNERS = ("timm/", "laion/")


def clip_model(name: Column) -> Column:
    """The full name of a CLIP model: aliases mean the default one, names by a hub's owner get the hub in front, others stay; white space around doesn't count."""
    value = F.trim(name, F.lit(" \t\n\r\f\x0b"))
    on_hub = value.startswith(HUB_OWNERS[0]) | value.startswith(HUB_OWNERS[1])
    return F.when(value.isin(*CLIP_ALIASES), DEFAULT_CLIP).when(on_hub, F.concat(F.lit("hf-hub:"), value)).otherwise(value)


def size_label(bytes_: Column) -> Column:
    """Bytes, or KB, MB or GB with two decimals, exact halves to even; n/a for null. Hundredths are counted in whole numbers, as a double's shortest digits may hide which side of a half it is on."""
    out = F.when(bytes_.isNull(), F.lit("n/a"))
    whole = bytes_.cast("double").cast("long")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        bits, one = 10 * power, 1 << 10 * power
        rest = whole.bitwiseAND(F.lit(one - 1).cast("long")) * 100
        down, over = F.shiftright(rest, bits), rest.bitwiseAND(F.lit(one - 1).cast("long"))
        up = (over > one // 2) | ((over == one // 2) & (down % 2 == 1))
        hundredths = F.shiftright(whole, bits) * 100 + down + up.cast("long")
        out = out.when(bytes_ >= one, F.format_string(f"%d.%02d {unit}", F.floor(hundredths / 100), hundredths % 100))
    return out.otherwise(F.format_string("%d B", bytes_))


def date_label(seconds: Column) -> Column:
    return F.coalesce(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"), F.lit("unknown"))


def duration_label(seconds: Column) -> Column:
    """h:mm:ss, or mm:ss below an hour."""
    total = F.round(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("long")
    h, m, s = F.floor(total / 3600), F.floor((total % 3600) / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def compact(messages: Column, limit: int = 500) -> Column:
    """The first 8 messages of a chain of causes in one line, cut to the limit."""
    whole = F.concat_ws(" <- caused by: ", F.slice(F.transform(messages, lambda m: F.trim(m)), 1, 8))
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.substring(whole, 1, limit - 3), F.lit("...")))


def important_exif(line: Column) -> Column:
    """Whether a line of the form key: value tells size, depth or dates."""
    key, value = F.lower(F.substring_index(line, ":", 1)), F.substr(line, F.instr(line, ":") + 1)
    phrase = F.lit(False)
    for p in EXIF_PHRASES:
        phrase = phrase | F.contains(key, F.lit(p))
    word = F.exists(F.split(key, "[^a-z0-9]"), lambda t: t.isin("width", "height"))
    return (F.instr(line, ":") > 0) & (F.trim(value) != "") & ~key.rlike("[xy] resolution") & (phrase | word)


def out_of_memory(message: Column) -> Column:
    return F.contains(F.lower(message), F.lit("out of memory"))


def gpu_error(message: Column) -> Column:
    return F.lower(message).rlike("|".join(GPU_MARKERS))


def embed_failure(message: Column) -> Column:
    """A failed face stage failed at embedding (true) or at detection (false)."""
    return F.contains(F.lower(F.coalesce(message, F.lit(""))), F.lit("embed"))


def system_block(text: Column) -> Column:
    """Lines of the section headed ---- System ---- of a listing, up to the next heading."""
    return F.trim(F.regexp_extract(text, r"(?s)---- System ----\s*\n(.*?)(?:\n---- |\z)", 1))
