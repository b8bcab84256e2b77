"""Predicates on files: which of them a rule may look at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as S

from ..functions import sql as F
from ..functions.core import all_of, any_of
from ..functions.glob import path_matches
from ..functions.sql import Expr, column
from ..functions.text import entropy
from ..spec.model import FileFilter, Rule

#: Columns of a table of files.
FILE_COLUMNS = ["doc_id", "path", "filename", "language", "file_type", "is_hidden", "content"]


def is_main(file_type: Expr) -> Expr:
    return file_type == "MAIN"


def in_language_scope(selectivity: str, language: Expr) -> Expr:
    """Rules for any analyzer look only at files of no known language."""
    return language.isNull() if selectivity == "analyzerGeneric" else F.lit(True)


def has_extension(filename: Expr, ext: str) -> Expr:
    """Case-insensitive; a leading dot, and what precedes a later one, is ignored; blank matches nothing."""
    wanted = ext.rpartition(".")[2] if ext.startswith(".") else ext
    if not wanted.strip():
        return F.lit(False)
    return F.lower(filename).endswith("." + wanted.lower())


def has_keyword(lowered: Expr, keyword: str) -> Expr:
    """Whether lower-cased content holds the keyword, in any case; blank matches nothing."""
    return F.contains(lowered, F.lit(keyword.lower())) if keyword.strip() else F.lit(False)


def _kinds(f: FileFilter, path: Expr, filename: Expr, lowered: Expr) -> list[list[Expr]]:
    return [[path_matches(path, p) for p in f.paths], [has_extension(filename, e) for e in f.ext], [has_keyword(lowered, k) for k in f.content]]


def included(f: FileFilter, path: Expr, filename: Expr, lowered: Expr) -> Expr:
    """One of each kind of condition that is there must hold."""
    return all_of([any_of(kind) for kind in _kinds(f, path, filename, lowered) if kind])


def rejected(f: FileFilter, path: Expr, filename: Expr, lowered: Expr) -> Expr:
    """Any condition of any kind rejects."""
    return any_of([c for kind in _kinds(f, path, filename, lowered) for c in kind])


_TEST_NAME = r"^test|tests?\.|\.spec\.(?:jsx?|tsx?)$|_(?:spec|test)\.rb$|\.t$"
_TEST_FOLDERS = "doc docs test tests e2e mock mocks __tests__ __fixtures__ testdata fixtures".split()


def looks_like_test(path: Expr) -> Expr:
    """Whether a path relative to its project names a test, by its file or one of its folders; absolute
    paths and those that leave the project are none."""
    plain = F.lower(F.translate(path, "\\", "/"))
    folders = F.slice(F.split(plain, "/"), F.lit(1), F.greatest(F.size(F.split(plain, "/")) - 1, F.lit(0)))
    name = F.substring_index(plain, "/", -1)
    by_folder = F.exists(folders, lambda d: d.isin(_TEST_FOLDERS) | d.endswith("test") | d.endswith("tests"))
    return ~plain.rlike(r"^(?:/|\.\./|[a-z]:)") & (name.rlike(_TEST_NAME) | by_folder)


_BINARY = (
    "3dm 3ds 3g2 3gp 7z a aac accdb adp ai aif aiff apk app ar arj arw asf asm avi avif bak bin blend bmp bz2 bzip2 cab caf cer cgm chm class cr2 crx cur dat db dbf dcm deb der dex djvu dll dmg dng doc docm docx dot dotx drw dsk "
    "dts dvi dwg dxf dylib ear ecelp elf eol eot epub exe f4v fbs fdt fh flac fla fli flv fon fpx fst fvt g3 gif graffle gz gzip h261 h263 h264 hdf5 heic heif icns ico ief img ipa iso jar jfif jks jp2 jpeg jpg jpgv jpm jxr kdbx key keystore ktx lha lib lib lvp lz lz4 lzh "
    "lzma lzo m3u m4a m4v mar mdb mdi mht mid midi mj2 mka mkv mmr mng mo mobi mov movie mp2 mp3 mp4 mp4a mpeg mpg mpga msi mxu nef node npx npy npz numbers o oga ogg ogv orf otf otc p12 pack pages parquet pbm pcap pcx pdb pdf pea pfx pgm pic pkl png pnm pot potm potx ppa ppam ppm pps ppsm "
    "ppsx ppt pptm pptx psd pya pyc pyo pyv qt raf rar ras raw rgb rip rlc rlib rmf rmvb rpm rtf rz s3m s7z sgi shar sil sketch slk smv snap so sqlite sqlite3 stl storyboard sub swf tar tbz tbz2 tga tgz thmx tif tiff tlz torrent ttc ttf txz udf uvh uvi uvm uvp uvs uvu vbox vdi vhd vmdk vob war wasm wav wax wbmp wdp weba "
    "webm webp whl wim wm wma wmv wmx woff woff2 wrm wvx xbm xif xla xlam xls xlsb xlsm xlsx xlt xltm xltx xm xmind xpi xpm xwd xz z zip zipx zst"
).split()


def looks_binary(filename: Expr) -> Expr:
    """Whether a name is one of binary files: by extension, of a certificate store, or a digest."""
    name = F.lower(filename)
    digest = F.length(name).isin(32, 40, 64, 128) & name.rlike("^[0-9a-f]+$") & (entropy(filename) > 3.1)
    return F.substring_index(name, ".", -1).isin(sorted(set(_BINARY))) & F.contains(name, F.lit(".")) | name.endswith("cacerts") | digest


def translation_file(path: Expr) -> Expr:
    """Android's translated strings, which may well hold bidirectional characters."""
    return path.rlike(r"(?:^|/)[^/]*res/values-[a-zA-Z-]+/strings\.xml$") | path.rlike(r"res/values-[a-zA-Z\-]+/strings\.xml$")


def suffix_excluded(path: Expr, suffixes: list[str]) -> Expr:
    return any_of([path.endswith(s) for s in suffixes])


def accepts(rule: Rule, path: Expr, filename: Expr, language: Expr, file_type: Expr, lowered: Expr) -> Expr:
    """All a rule asks of a file, cheap conditions first; tests by name are dealt with apart."""
    conditions = [is_main(file_type), in_language_scope(rule.selectivity, language)]
    if rule.pre.reject != FileFilter():
        conditions.append(~rejected(rule.pre.reject, path, filename, lowered))
    if rule.pre.include != FileFilter():
        conditions.append(included(rule.pre.include, path, filename, lowered))
    return all_of(conditions)


def keyword_gate(rules: list[Rule], path: Expr, filename: Expr, language: Expr, file_type: Expr, lowered: Expr) -> Expr:
    """Whether a keyword of any rule is in a text; rules without keywords let through the files that they accept
    by path. Keywords that hold another one needn't be looked for."""
    keywords = {k.lower() for r in rules if r.keyword_routed for k in r.pre.include.content if k.strip()}
    least = sorted(k for k in keywords if not any(x != k and x in k for x in keywords))
    by_path = [accepts(r, path, filename, language, file_type, lowered) for r in rules if not r.keyword_routed]
    return any_of([*by_path, *(has_keyword(lowered, k) for k in least)])


def routes(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, rule_key) of the checks that a file's keywords call for, each once; keys with a rule
    without keywords are called always."""
    by_key: dict[str, set[str] | None] = {}
    for r in rules:
        seen = by_key.get(r.key, set())
        by_key[r.key] = None if seen is None or not r.keyword_routed else seen | {k.lower() for k in r.pre.include.content}
    called = [F.when(F.lit(True) if words is None else any_of([has_keyword(F.col("lowered"), w) for w in sorted(words)]), F.lit(key)) for key, words in sorted(by_key.items())]
    keys = F.filter(F.array(*called), lambda k: k.isNotNull())
    return files.select("doc_id", S.lower("content").alias("lowered")).select("doc_id", S.explode(column(keys)).alias("rule_key"))


def active(rules: list[Rule], profile: set[str] | None = None) -> list[Rule]:
    """Rules whose key is in the quality profile, by default those that say they are."""
    return [r for r in rules if (r.key in profile if profile is not None else r.in_default_profile)]


def tracked(files: DataFrame, dirty: DataFrame, git_ok: bool = True) -> DataFrame:
    """Files without changes that aren't committed, and none of Git's own. dirty: (path). If git failed, all."""
    if not git_ok:
        return files
    outside = files.where(~S.contains(S.concat(S.lit("/"), "path"), S.lit("/.git/")))
    return outside.join(dirty.select("path").distinct(), "path", "left_anti").select(*files.columns)


