"""OCR of PDF pages: which libraries it needs, the way from a page to its text, and a check that it works.

Every library is optional and loaded when it is used, by the tasks; `missing` says which of them a run would lack. Without
OpenCV pages are read as they are. The main path of the engine needs none of this: OCR is a function (file, page number) -> text.
"""

from __future__ import annotations

import importlib
import importlib.util
import io
import os
import shutil
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

from leafmark.sources.adapters import ExtractorUnavailable, health

#: Module and what it is called, by what it is for. OpenCV only makes OCR better.
NEEDED = {"pdf": {"fitz": "PyMuPDF"}, "ocr": {"pytesseract": "pytesseract", "PIL": "Pillow"}, "epub": {}}
#: Dots per inch of a page's picture, engine, and the segmentation modes for one block of text and for anything.
DPI, ENGINE, ONE_BLOCK, AUTOMATIC = 300, 1, 6, 3
#: Fixed values of the preparation: least dark points for a slope, slopes that are mended (degrees), window and offset of the threshold.
LEAST_INK, SLOPES, WINDOW, OFFSET = 1000, (0.5, 15.0), 31, 10
LEVELS_UP = 8


def missing(kinds: set[str]) -> list[str]:
    """Libraries that these kinds of work need and that aren't there."""
    out = [name for kind in sorted(kinds) for module, name in NEEDED[kind].items() if importlib.util.find_spec(module) is None]
    return out + (["tesseract"] if "ocr" in kinds and tesseract_binary() is None else [])


def _module(name: str) -> ModuleType:
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ExtractorUnavailable(f"{name} is not installed") from e


def tesseract_binary(start: str = __file__) -> str | None:
    """TESSERACT_CMD if it is a file, else the one of an application bundle around this file, else the one on the path."""
    told = os.environ.get("TESSERACT_CMD")
    if told and os.path.isfile(told):
        return told
    for folder in list(Path(start).resolve().parents)[:LEVELS_UP]:
        if folder.name == "Contents" and folder.parent.suffix == ".app":
            bundled = folder / "Resources" / "bin" / "tesseract"
            if bundled.is_file() and (folder / "Resources" / "tessdata").is_dir():
                return str(bundled)
    return shutil.which("tesseract")


def page_image(document, number: int, dpi: int = DPI):
    """The picture of a page (from 1) of an open PDF; PDF units are 72 to the inch."""
    fitz, image = _module("fitz"), _module("PIL.Image")
    pixels = document[number - 1].get_pixmap(matrix=fitz.Matrix(dpi / 72, dpi / 72), alpha=False)
    return image.open(io.BytesIO(pixels.tobytes("png")))


def _slope(cv2: ModuleType, np: ModuleType, gray) -> float:
    """By how many degrees the text is turned, from the smallest rectangle around all ink; 0 if there is too little of it."""
    _, ink = cv2.threshold(255 - gray, 0, 255, cv2.THRESH_BINARY + cv2.THRESH_OTSU)
    points = np.argwhere(ink > 0)
    if len(points) <= LEAST_INK:
        return 0.0
    angle = cv2.minAreaRect(points)[-1]
    return -(angle + 90) if angle < -45 else -angle


def _upright(cv2: ModuleType, np: ModuleType, gray):
    slope = _slope(cv2, np, gray)
    if not SLOPES[0] < abs(slope) < SLOPES[1]:
        return gray
    height, width = gray.shape[:2]
    turn = cv2.getRotationMatrix2D((width // 2, height // 2), slope, 1.0)
    return cv2.warpAffine(gray, turn, (width, height), flags=cv2.INTER_CUBIC, borderMode=cv2.BORDER_REPLICATE)


#: What is done to a picture, in this order; a step that fails is left out.
STEPS = (
    _upright,
    lambda cv2, np, gray: cv2.fastNlMeansDenoising(gray, None, h=10, templateWindowSize=7, searchWindowSize=21),
    lambda cv2, np, gray: cv2.adaptiveThreshold(gray, 255, cv2.ADAPTIVE_THRESH_GAUSSIAN_C, cv2.THRESH_BINARY, WINDOW, OFFSET),
)


def prepared(picture):
    """The picture upright, without noise, black on white. Without OpenCV, the picture itself."""
    if importlib.util.find_spec("cv2") is None:
        return picture
    cv2, np, image = _module("cv2"), _module("numpy"), _module("PIL.Image")
    gray = np.asarray(picture)
    gray = cv2.cvtColor(gray, cv2.COLOR_RGB2GRAY) if gray.ndim == 3 else gray
    for step in STEPS:
        try:
            gray = step(cv2, np, gray)
        except Exception:  # a page that can't be prepared is still read
            continue
    return image.fromarray(gray)


def segmentation(picture) -> int:
    """One block if the page's runs of ink are of much the same height (or there are none), else automatic."""
    if importlib.util.find_spec("cv2") is None:
        return ONE_BLOCK
    cv2, np = _module("cv2"), _module("numpy")
    try:
        _, ink = cv2.threshold(np.asarray(picture.convert("L")), 0, 255, cv2.THRESH_BINARY_INV + cv2.THRESH_OTSU)
        joined = cv2.morphologyEx(ink, cv2.MORPH_CLOSE, cv2.getStructuringElement(cv2.MORPH_RECT, (15, 3)))
        shapes = cv2.findContours(joined, cv2.RETR_EXTERNAL, cv2.CHAIN_APPROX_SIMPLE)[0]
        return mode_of([cv2.boundingRect(s)[3] for s in shapes])
    except Exception:
        return ONE_BLOCK


def mode_of(heights: list[int]) -> int:
    """The mode for runs of ink of these heights: more than four in five within 30 % of the median are one block."""
    if not heights:
        return ONE_BLOCK
    tall = sorted(h for h in heights if h > 5)
    if len(tall) < 3:
        return AUTOMATIC
    median = tall[len(tall) // 2]
    alike = sum(0.7 * median <= h <= 1.3 * median for h in tall)
    return ONE_BLOCK if alike > 0.8 * len(tall) else AUTOMATIC


def read_picture(picture) -> str:
    """What the engine reads; nothing if it fails."""
    engine = _module("pytesseract")
    if binary := tesseract_binary():
        engine.pytesseract.tesseract_cmd = binary
    clean = prepared(picture)
    try:
        return engine.image_to_string(clean, lang="eng", config=f"--oem {ENGINE} --psm {segmentation(clean)}")
    except Exception:
        return ""


def of_folder(folder: str) -> Callable[[str, int], str]:
    """OCR for the files of a folder that the executors share."""

    def ocr(file: str, number: int) -> str:
        with _module("fitz").open(os.path.join(folder, file)) as document:
            return read_picture(page_image(document, number))

    return ocr


def self_test() -> tuple[bool, str]:
    """Whether the engine reads a picture that says "Hello world"."""

    def ocr(_: bytes) -> str:
        image, draw = _module("PIL.Image"), _module("PIL.ImageDraw")
        picture = image.new("RGB", (300, 80), color="white")
        draw.Draw(picture).text((20, 25), "Hello world", fill="black")
        return _module("pytesseract").image_to_string(picture, lang="eng", config=f"--oem {ENGINE} --psm {ONE_BLOCK}")

    return health(ocr, b"")
