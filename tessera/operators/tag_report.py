"""A second opinion on clean copies: tags that another tool lists and that say more than how a picture is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.hdr import ADOBE, APPLE, NUMBERS, PIXELS, WORDS, is_plain_number

# Groups that are private as a whole, groups that are never looked at, and tags by what they mean.
PRIVATE_GROUPS = ("XMP", "IPTC", "MakerNotes", "Photoshop", "GPS", "PLIST")
PASSED_GROUPS = ("SourceFile", "ExifTool", "ICC_Profile", "Composite")
DISPLAY_TAGS = ("Orientation", "ColorSpace", "Gamma", "InteropIndex", "ExifVersion", "FlashpixVersion", "ComponentsConfiguration", "YCbCrPositioning", "XResolution", "YResolution", "ResolutionUnit")
TIFF_TAGS = (
    "ImageWidth", "ImageHeight", "BitsPerSample", "Compression", "PhotometricInterpretation", "Thresholding", "FillOrder", "StripOffsets",
    "SamplesPerPixel", "RowsPerStrip", "StripByteCounts", "PlanarConfiguration", "T4Options", "T6Options", "Group3Options", "Group4Options",
    "PageNumber", "TransferFunction", "WhitePoint", "PrimaryChromaticities", "ColorMap", "HalftoneHints", "TileWidth", "TileLength", "TileOffsets",
    "TileByteCounts", "ExtraSamples", "SampleFormat", "SMinSampleValue", "SMaxSampleValue", "MinSampleValue", "MaxSampleValue", "JPEGTables",
    "JPEGProc", "YCbCrCoefficients", "YCbCrSubSampling", "ReferenceBlackWhite", "Predictor", "InkSet", "NumberofInks", "DotRange", "TransferRange",
    "SubfileType", "OldSubfileType", "GrayResponseUnit", "GrayResponseCurve", "PreviewImageStart", "PreviewImageLength", "PreviewImage",
)
PRIVATE_TAG = (
    "(?i)gps|latitude|longitude|location|serialnumber|ownername|^(?:make|model|artist|author|creator|comment|description|imagedescription|copyright|"
    "software|datetimeoriginal|createdate|modifydate|creationdate|creationtime|trackcreatedate|trackmodifydate|mediacreatedate|mediamodifydate)$"
)
UNKNOWN_TAG = "(?i)^Unknown|_0x[0-9a-f]{4}$"
EMPTY = ["", "0", "0000:00:00 00:00:00"]
RENDERING_GROUPS = {"XMP-hdrgm": ADOBE, "XMP-apdi": PIXELS, "XMP-HDRGainMap": APPLE}


def is_rendering(group: Column, detail: Column, tag: Column, values: Column) -> Column:
    """Whether a tag with these values (an array of texts) is a number that rendering reads."""
    numbers = F.size(values).isin(1, 3) & F.forall(values, is_plain_number)
    out = (group == "MakerNotes") & (detail == "Apple") & tag.isin("HDRHeadroom", "HDRGain") & numbers
    for name, space in RENDERING_GROUPS.items():
        words = [(local, allowed) for (own, local), allowed in WORDS.items() if own == space]
        listed = tag.isin(*NUMBERS[space]) & numbers
        for local, allowed in words:
            listed = listed | (tag == local) & (F.size(values) == 1) & F.get(values, F.lit(0)).isin(*allowed)
        out = out | (group == "XMP") & (detail == name) & listed
    return F.coalesce(out, F.lit(False))


def remaining(report: DataFrame, structure: list[str] | None = None) -> DataFrame:
    """Rows of ``report`` (``file_id, kind, key, values``; a key is group, detail and tag joined by colons) that may not remain.

    ``structure`` lists unknown tags of movies that are known to be structure. Null values count as empty.
    """
    part = F.split("key", ":")
    group, tag = F.get(part, F.lit(0)), F.element_at(part, -1)
    detail = F.when(F.size(part) > 2, F.get(part, F.lit(1))).otherwise("")
    passed = group.isin(*PASSED_GROUPS) | (group == "File") & (F.get(part, F.lit(1)) == "System")
    allowed = tag.isin(*DISPLAY_TAGS) | (F.col("kind") == "TIFF") & tag.isin(*TIFF_TAGS)
    value = F.coalesce(F.array_join("values", ","), F.lit(""))
    private = group.isin(*PRIVATE_GROUPS) | (group == "EXIF") & ~F.coalesce(allowed, F.lit(False)) | (group != "EXIF") & tag.rlike(PRIVATE_TAG) & ~value.isin(*EMPTY)
    unknown = tag.rlike(UNKNOWN_TAG) & ~((group == "QuickTime") & tag.isin(*(structure or [""])))
    return report.filter(~F.coalesce(passed, F.lit(False)) & ~is_rendering(group, detail, tag, F.coalesce("values", F.array())) & F.coalesce(private | unknown, F.lit(False)))
