"""File-upload rules. Patterns, severities and categories are fixed values."""

from .base import CRITICAL, HIGH, LOW, MEDIUM, Pack, ci

PACK = Pack("upload", "file-upload", "A03")
add = PACK.add

add("any_type", CRITICAL, "unrestricted-file-type",
    has=r"multer|express-fileupload|busboy|formidable",
    lacks=ci(r"fileFilter|filter|allowedTypes|mimeTypes"), line=r"multer|express-fileupload",
    title="Any kind of file may be uploaded",
    fix="Accept only the kinds you need.", better="Deny by default.")
add("no_mime", HIGH, "missing-mime-validation",
    has=r"req\.files|fileUpload|upload", lacks=ci(r"mimetype|content-type|magic-number"),
    line=r"req\.files|fileUpload",
    title="Content of uploads is not inspected",
    fix="Compare the leading bytes with the stated kind.", better="Do not trust file names.")
add("no_size", MEDIUM, "missing-size-limit", owasp="A04",
    has=r"multer|upload", lacks=ci(r"limits.*fileSize|maxFileSize|size.*limit"),
    title="Uploads have no size limit",
    fix="Set a size limit.", better="Also limit the number of files.")
add("path_traversal", HIGH, "path-traversal-risk", owasp="A01",
    has=[r"req\.files|upload", r"originalname|filename"],
    lacks=ci(r"sanitize|path\.basename|replace.*[\/\\]"), line=r"originalname|filename",
    title="File name from the client used as a path",
    fix="Store under a name of your own making.", better="Keep the client name as data only.")
add("public_store", MEDIUM, "public-storage", owasp="A01",
    has=[r"destination|dest|storage", ci(r"public|static|www")],
    lacks=ci(r"signed-url|private|authenticated"), line=r"destination|dest",
    title="Uploads land in a public folder",
    fix="Store them privately and hand out short-lived links.", better="Separate code and uploads.")
add("no_malware_scan", LOW, "missing-malware-scan", owasp="A04",
    has=[r"upload|file", r"multer|express-fileupload|req\.files"],
    lacks=ci(r"clamav|malware|virus|scan"), line=r"multer|upload",
    title="Uploads are not checked for malware",
    fix="Check each file before others can fetch it.", better="Quarantine until checked.")
