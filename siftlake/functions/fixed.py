"""Signatures, families, weights and limits that results depend on."""

# Fixed values, in the order in which they are tested.
SIGNATURES = {
    "jpeg": "FFD8FF",
    "png": "89504E470D0A1A0A",
    "gif": "47494638",
    "pdf": "255044462D",
    "zip": "504B0304",
    "sqlite": "53514C69746520666F726D6174203300",
}
MP4_MARK = "66747970"  # at byte 4
FAMILY = {
    "jpeg_header": "jpeg",
    "jpeg_data": "jpeg",
    "pdf_text": "pdf",
    "sqlite_page": "sqlite",
    "zip_struct": "compressed",
    "high_entropy": "compressed",
    "log_text": "log",
    "text": "text",
    "xml_text": "xml",
    "fat_dir": "fat_dir",
    "binary": "binary",
    "zero": "zero",
    "png_header": "png",
    "gif_header": "gif",
    "mp4_header": "mp4",
}
EDGE_WEIGHTS = {
    "type_compat": -0.002797618430506595,
    "struct_order": 0.40352766448433797,
    "index_verified": 0.4919539403113012,
    "boundary_smooth": 0.5547473690487564,
    "entropy_sim": 0.05252084044825006,
    "hist_sim": -0.1304338482443348,
    "proximity": -0.30412100888977195,
    "content_sim": -0.7818233272177741,
    "time_consistent": 0.3979552061698297,
}
EDGE_BIAS = -2.069531428292731
EDGE_MEAN = {
    "type_compat": 0.9985538684020245,
    "struct_order": 0.6048877953764262,
    "index_verified": 0.016449746926970356,
    "boundary_smooth": 0.510186640593529,
    "entropy_sim": 0.9908118084000512,
    "hist_sim": 0.976438723495185,
    "proximity": 0.36217974592730967,
    "content_sim": 0.9058428554426704,
    "time_consistent": 0.4933193111836247,
}
EDGE_STD = {
    "type_compat": 0.038000530277574975,
    "struct_order": 0.12022427954926362,
    "index_verified": 0.12719729852872902,
    "boundary_smooth": 0.1198700036063957,
    "entropy_sim": 0.05102684141935268,
    "hist_sim": 0.12141469029468512,
    "proximity": 0.25239191317161797,
    "content_sim": 0.11229724100113651,
    "time_consistent": 0.0730389912429836,
}
TYPE_WEIGHTS = {"Document": 1.0, "Database": 0.8, "Image": 0.5, "Log": 0.5, "Archive": 0.4, "Other": 0.2}
PRIORITY_WEIGHTS = {"integrity": 0.25, "reconstruction": 0.20, "relationship": 0.15, "relevance": 0.40}
PRIORITY_BANDS = {"CRITICAL": 88, "HIGH": 72, "MEDIUM": 52, "LOW": 35}
RELATION_LABELS = ((0.9, "Strong"), (0.75, "Probable"), (0.55, "Possible"), (0.35, "Weak"))
# How sure a directory's name is: its long form with the checksum of the short one, deleted with and without its first
# letter found again, the short form alone. Letters a short name may begin with.
NAME_SURE = {"long": 0.98, "deleted, letter found": 0.95, "deleted": 0.8, "short": 0.6}
SHORT_NAME_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
# End of fixed values.

CLUSTER = 4096
SECTOR = 512
