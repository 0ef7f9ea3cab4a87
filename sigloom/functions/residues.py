"""Alphabet, background frequencies, substitution scores and profile classes."""

from __future__ import annotations

# The twenty residues in the order of every matrix, with background frequencies.
FREQUENCIES = {
    "A": 0.074, "R": 0.042, "N": 0.044, "D": 0.059, "C": 0.033, "Q": 0.058, "E": 0.037, "G": 0.074, "H": 0.029, "I": 0.038,
    "L": 0.076, "K": 0.072, "M": 0.018, "F": 0.040, "P": 0.050, "S": 0.081, "T": 0.062, "W": 0.013, "Y": 0.033, "V": 0.068,
}
ALPHABET = "".join(FREQUENCIES)
WINDOW, CENTRE = 11, 5

# The public PAM250 scores, lower triangle in the alphabet's order.
PAM250_ROWS = """
2
-2 6
0 0 2
0 -1 2 4
-2 -4 -4 -5 12
0 1 1 2 -5 4
0 -1 1 3 -5 2 4
1 -3 0 1 -3 -1 0 5
-1 2 2 1 -3 3 1 -2 6
-1 -2 -2 -2 -2 -2 -2 -3 -2 5
-2 -3 -3 -4 -6 -2 -3 -4 -2 2 6
-1 3 1 0 -5 1 0 -2 0 -2 -3 5
-1 0 -2 -3 -5 -1 -2 -3 -2 2 4 0 6
-3 -4 -3 -6 -4 -5 -5 -5 -2 1 2 -5 0 9
1 0 0 -1 -3 0 -1 0 0 -2 -3 -1 -2 -5 6
1 0 1 0 0 -1 0 1 -1 -1 -3 0 -2 -3 1 2
1 -1 0 0 -2 -1 0 0 -1 0 -2 0 -1 -3 0 1 3
-6 2 -4 -7 -8 -5 -7 -7 -3 -5 -2 -3 -4 0 -6 -2 -5 17
-3 -4 -2 -4 0 -4 -4 -5 0 -1 -1 -4 -2 7 -5 -3 -3 0 10
0 -2 -2 -2 -2 -2 -2 -1 -2 4 2 -2 2 -1 -1 -1 0 -6 -2 4
"""

# Profiles whose acceptor is tyrosine, and those with serine or threonine.
TYROSINE_PROFILES = "ABL ALK BLK BRK FRK HCK INSR LCK LYN MET NEK10_Y RET SRC YES EGFR InsR SHC1 SH2_PLCG1 SH2_INPP5D SH2_SH3BP2 SH2_SHC2 SH2_SHE SH2_Syk SH2_TNS4 EphA3".split()
SERINE_PROFILES = "AKT CK2 ERK2 NEK1 NEK2 NEK3 NEK4 NEK5 NEK6 NEK7 NEK8 NEK9 NEK10_S PKA PKC-theta PKD PLM2 TbetaRII BRCA1 AMPK CDK5 CK1 DMPK1 p38 ERK1 CLK2 DAPK3 ICK STK11 MST1 MST4 PAK2 Pim1 Pim2 SLK TGFbR2 TLK1 TNIK p70S6K".split()


def pam250() -> list[list[int]]:
    """The symmetric 20 x 20 matrix."""
    rows = [[int(x) for x in line.split()] for line in PAM250_ROWS.split("\n") if line]
    return [[rows[max(i, j)][min(i, j)] for j in range(20)] for i in range(20)]


def profile_classes() -> dict[str, str]:
    return dict.fromkeys(TYROSINE_PROFILES, "Y") | dict.fromkeys(SERINE_PROFILES, "S/T")
