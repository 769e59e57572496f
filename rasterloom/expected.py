"""The served tables written out a second time, for the SQL that checks them.

They are stated from the specification, not taken from the operators' constants, so that a slip there shows.
"""

from __future__ import annotations

#: id, name, tolerance, padding, search radius, mode.
REPAIR_PROFILES = """
('thin-text', 'Thin Text / Script', CAST(28 AS INTEGER), CAST(1 AS INTEGER), CAST(30 AS INTEGER), 'solid'),
('soft-flower', 'Soft Flower / Pastel', 18, 2, 80, 'original'),
('light-dress', 'Light Dress / Subject', 22, 2, 40, 'original'),
('gold-crown', 'Gold Crown / Metallic', 26, 2, 50, 'original'),
('solid-shape', 'Solid Shape', 20, 1, 60, 'solid')"""

#: name, width, height, fit, description.
PRINT_PRESETS = """
('Shirt Front', CAST(12 AS DOUBLE), CAST(0 AS DOUBLE), 'contain', '12in wide, full chest'),
('Shirt Back', 12, 16, 'contain', '12 × 16in'),
('Pocket', 4, 4, 'contain', '4 × 4in left chest'),
('Sticker (S)', 3, 3, 'contain', '3 × 3in'),
('Sticker (L)', 5, 5, 'contain', '5 × 5in'),
('Hat', 4.5, 2.25, 'contain', '4.5 × 2.25in front panel'),
('Mug Wrap', 8.5, 3, 'contain', '8.5 × 3in'),
('A4 Paper', 8.27, 11.69, 'contain', 'Full sheet')"""

#: label, width, height.
COMMON_PRINT_SIZES = """
('4 × 6 in (acrylic mini)', CAST(4 AS DOUBLE), CAST(6 AS DOUBLE)),
('5 × 7 in (acrylic standard)', 5, 7),
('6 × 9 in (acrylic large)', 6, 9),
('8 × 10 in (acrylic XL)', 8, 10),
('Source size (no resize)', 0, 0)"""

#: label, hex.
TEXT_SWATCHES = """
('Antique gold', '#b8956a'), ('Champagne', '#d4b97a'), ('Rose gold', '#c08a7a'), ('Dusty rose', '#c87a93'),
('Blush', '#dca7b3'), ('Sage', '#8aa686'), ('Hunter green', '#5a7a5a'), ('Navy', '#1a2a4f'),
('Charcoal', '#2c2c2c'), ('Black', '#000000'), ('White', '#ffffff'), ('Ivory', '#fbf6e8')"""

#: id, label, description, group.
CRITIQUES = """
('amount-not-enough', 'Background still showing', 'Not enough was removed — increase tolerance.', 'amount'),
('amount-too-much', 'Removed too much of the design', 'The subject lost pixels — decrease tolerance / unchoke.', 'amount'),
('interior-lost', 'White inside the design got eaten', 'Switch to flood-fill so only edge-connected background is removed; preserves white inside flowers/dress/letters.', 'interior'),
('edge-halo', 'Fuzzy halo / fringe on edges', 'Increase edge choke and threshold to harden cutout edges.', 'edges'),
('edge-jaggy', 'Jagged stair-step edges', 'Increase feather to soften before thresholding.', 'edges'),
('edge-shrunk', 'Edges nibbled too thin', 'Reduce choke and lower threshold so more edge pixels stay.', 'edges'),
('edge-soft', 'Edges look too soft / blurry', 'Reduce feather and ensure solid-edge thresholding is on.', 'edges'),
('color-tint', 'Color tint on edges', 'Enable auto-despill — neutralizes leftover green/blue/red on edge pixels.', 'color'),
('color-tint-clean', 'Edges look clean (no tint)', 'Despill not needed — disable to skip extra processing.', 'color')"""

#: priority, pattern, critique.
KEYWORD_RULES = r"""
(CAST(0 AS INTEGER), '\b(inside|interior|inner|within|center|middle)\b.*\b(white|light|gone|removed|missing|lost|eaten|disappear)', 'interior-lost'),
(1, '\b(white|light)\b.*\b(inside|interior|inner|within)\b.*\b(gone|removed|missing|lost|eaten|disappear)', 'interior-lost'),
(2, '\b(flowers?|dress|butterfl(y|ies)|letters?|crown|hair)\b.*\b(white|gone|removed|missing|lost|eaten|disappear)', 'interior-lost'),
(3, '\b(halo|fringe|fuzzy|fuzz|glow|aura|outline.*background|ghost)\b', 'edge-halo'),
(4, '\b(jagged|jaggy|jaggies|stair|aliased|pixelated edges?|stepped)\b', 'edge-jaggy'),
(5, '\b(nibbled|chewed|eaten|bitten|too small|shrunk|shrank|outline lost|too thin|chopped)\b', 'edge-shrunk'),
(6, '\b(blurr?y|smudged?|too soft|soft edges?|fuzzy soft)\b', 'edge-soft'),
(7, '\b(tint(ed)?|spill|colou?r.*edges?|green.*edges?|yellow.*edges?|gray.*edges?|blue.*edges?)\b', 'color-tint'),
(8, '\b(removed|deleted|gone|missing).{0,30}\b(too much|too many|much of|subject|design|all)\b', 'amount-too-much'),
(9, '\b(too aggressive|over.?(removed|did)|ate the (design|subject))', 'amount-too-much'),
(10, '\b(background|bg).{0,30}\b(still|left|visible|shown|showing|remain|there)', 'amount-not-enough'),
(11, '\b(not enough|didn''?t remove|need.*more|missed (some|spots))', 'amount-not-enough')"""

#: id, label, category, weights, italic, size factor.
FONTS = """
('allura', 'Allura', 'script', [400], false, CAST(0.13 AS DOUBLE)), ('great-vibes', 'Great Vibes', 'script', [400], false, 0.13),
('pinyon-script', 'Pinyon Script', 'script', [400], false, 0.13), ('italianno', 'Italianno', 'script', [400], false, 0.16),
('petit-formal-script', 'Petit Formal Script', 'script', [400], false, 0.12), ('alex-brush', 'Alex Brush', 'script', [400], false, 0.14),
('sacramento', 'Sacramento', 'script', [400], false, 0.12), ('yellowtail', 'Yellowtail', 'script', [400], false, 0.12),
('parisienne', 'Parisienne', 'script', [400], false, 0.12), ('tangerine', 'Tangerine', 'script', [400, 700], false, 0.16),
('dancing-script', 'Dancing Script', 'script', [400, 600, 700], false, 0.11), ('pacifico', 'Pacifico', 'script', [400], false, 0.10),
('cinzel', 'Cinzel', 'display', [400, 600, 700], false, 0.06), ('cinzel-decorative', 'Cinzel Decorative', 'display', [400, 700], false, 0.06),
('playfair-display', 'Playfair Display', 'display', [400, 600, 700], true, 0.07), ('cormorant-garamond', 'Cormorant Garamond', 'body', [400, 500, 600, 700], true, 0.035),
('eb-garamond', 'EB Garamond', 'body', [400, 500, 600, 700], true, 0.035), ('crimson-text', 'Crimson Text', 'body', [400, 600, 700], true, 0.035),
('cardo', 'Cardo', 'body', [400, 700], true, 0.035), ('montserrat', 'Montserrat', 'body', [300, 400, 500, 600, 700], false, 0.03), ('lato', 'Lato', 'body', [300, 400, 700], false, 0.03)"""

#: kind, name, brightness, contrast, saturation, vibrance, sharpen, shadows, highlights, warmth, edge cleanup, automatic levels.
ADJUSTMENTS = """
('photo', 'auto', CAST(5 AS INTEGER), CAST(12 AS INTEGER), CAST(8 AS INTEGER), CAST(18 AS INTEGER), CAST(25 AS INTEGER), CAST(18 AS INTEGER), CAST(-10 AS INTEGER), CAST(4 AS INTEGER), CAST(NULL AS INTEGER), true),
('photo', 'neutral', 0, 0, 0, 0, 0, 0, 0, 0, NULL, false),
('graphic', 'auto', NULL, 15, NULL, 25, 35, NULL, NULL, NULL, 20, NULL),
('graphic', 'neutral', NULL, 0, NULL, 0, 0, NULL, NULL, NULL, 0, NULL)"""

#: id, name, color, tolerance, strategy, edge feather, solid edges, alpha threshold, choke, despill.
BG_REMOVAL_PRESETS = """
('acrylic-invite', 'Acrylic Invite', '#ffffff', CAST(12 AS DOUBLE), 'flood', CAST(1 AS DOUBLE), true, CAST(128 AS INTEGER), CAST(1 AS INTEGER), true),
('logo-on-white', 'Logo on White', '#ffffff', 8, 'flood', 0, true, 128, 0, true),
('logo-on-black', 'Logo on Black', '#000000', 12, 'flood', 1, true, 128, 1, true),
('green-screen', 'Green Screen', '#00b140', 22, 'global', 1, true, 128, 0, true),
('blue-screen', 'Blue Screen', '#0047ab', 22, 'global', 1, true, 128, 0, true)"""


def table(rows: str, names: str) -> str:
    return f"SELECT * FROM (VALUES {rows.strip()}) t({names})"
