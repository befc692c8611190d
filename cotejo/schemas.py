"""Explicit schemas of the input tables; readers never infer."""

from __future__ import annotations

CLAIM = (
    "id_reclamo string, fecha_envio string, "
    "proveedor struct<nombre: string, tipo_servicio: string>, estado string, "
    "monto_solicitado double, monto_aprobado double, moneda string, "
    "acciones struct<ver: boolean, subir: boolean>"
)
CLAIM_FILE = (
    "reclamos array<struct<id_reclamo: string, fecha_envio: string, "
    "proveedor: struct<nombre: string, tipo_servicio: string>, estado: string, "
    "monto_solicitado: double, monto_aprobado: double, moneda: string, "
    "acciones: struct<ver: boolean, subir: boolean>>>, "
    "metadatos struct<total_reclamos: bigint, ultima_actualizacion: string, estados_disponibles: array<string>>"
)
RAW_DOCS = "doc_id string, name string, content binary, size_bytes bigint"
DOC_TEXT = "doc_id string, source string, text string"
PDF_META = (
    "doc_id string, creation_date string, mod_date string, producer string, creator string, "
    "author string, pages int, encrypted boolean"
)
WORDS = "doc_id string, page int, word_no bigint, x0 double, y0 double, x1 double, y1 double, text string"
BLOCKS = "doc_id string, page int, block_no bigint, type int, x0 double, y0 double, x1 double, y1 double"
SPANS = "doc_id string, page int, line_no bigint, font string, origin_x double, dir_x double, dir_y double"
PDF_IMAGES = (
    "doc_id string, page int, name string, w_px int, h_px int, x0 double, y0 double, x1 double, y1 double, "
    "filters string, n_bytes bigint, sha256 string, phash string, mean double, variance double, "
    "border_share double"
)
DRAWINGS = "doc_id string, page int, draw_no bigint, filled boolean, x0 double, y0 double, x1 double, y1 double"
ANNOTS = (
    "doc_id string, page int, annot_no bigint, subtype string, x0 double, y0 double, x1 double, y1 double, "
    "content string, has_appearance boolean"
)
LAYER_DIFFS = "doc_id string, page int, kind string, k int, diff_ratio double"
ITEMS = (
    "doc_id string, source string, item_no bigint, descripcion string, cantidad double, "
    "precio_unitario double, descuento double, precio_total double, iva double, tarifa double"
)
SIGNATURES = (
    "doc_id string, sig_no int, br0 bigint, br1 bigint, br2 bigint, br3 bigint, subfilter string, "
    "digest_match boolean, crypto_ok boolean, chain_ok boolean"
)
IMAGE_META = "image_id string, width int, height int, exif map<string,string>, xmp map<string,string>"
IMAGE_HASHES = "image_id string, sha256 string, phash string, dhash string, whash string"
TILES = "image_id string, plane string, level int, ty int, tx int, px array<smallint>"
OCR_TOKENS = (
    "image_id string, token_no bigint, text string, conf double, left int, top int, width int, height int"
)
TOKEN_STATS = (
    "image_id string, token_no bigint, var double, mean double, std double, min double, max double, "
    "edge_share double, sw_mean double, sw_cv double, ela_in double, ela_ring double, entropy double, "
    "halo double, coherence double, z_hf double, dom_bins int, colorish boolean"
)
LINE_SEGMENTS = "image_id string, x1 double, y1 double, x2 double, y2 double"
COMPONENTS = (
    "image_id string, comp_no bigint, area bigint, aspect double, edge_ratio double, w_cv double, "
    "roi_inter double, solidity double, hue_var double, colour_share double"
)
BLOCK_HASHES = "image_id string, block_no bigint, phash string"
KEYPOINTS = "image_id string, kp_id bigint, x double, y double, descriptor array<tinyint>"
SRI_XML = "clave string, xml string"
SRI_AUTH = (
    "clave string, autorizaciones array<struct<estado: string, numeroAutorizacion: string, "
    "fechaAutorizacion: string, ambiente: string, comprobante: string>>"
)
WEIGHTS = "check_key string, weight int"
DESCRIPTIONS = "check_key string, valor int, descripcion string, explicacion string"
LEVELS = "level_no int, level string, lo int, hi int"
CHECKS = "doc_id string, section string, check_key string, detail string, penalty int"
