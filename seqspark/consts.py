"""Reserved ids, reserved symbols and the fixed molecule vocabularies."""

PAD, EOS, UNK = 1, 2, 3

# Reserved symbols in id order.
PLAIN_SPECIALS = ["<Lua heritage>", "<pad>", "</s>", "<unk>"]
MOLECULE_SPECIALS = ["<mask>", "<pad>", "</s>", "<unk>", "<go>"]
MASK, GO = 0, 4

BPE_MARK = "@@"

# Two-character units of the short molecule tokenizer.
SHORT_UNITS = ["Cl", "Br", "10", "Ru"]

# Token list of the short molecule vocabulary, in id order from 5.
SHORT_MOLECULE_TOKENS = (
    "c C ) ( 1 2 O N [ ] @ H n 3 = 4 + F S s Cl o 5 - # Br / \\ 6 I 7 8 9 P p B b % . Ru 10"
).split(" ")

# Token list of the general molecule vocabulary, in id order from 5.
GENERAL_MOLECULE_TOKENS = (
    "c C ( ) 1 O 2 N = 3 n [C@@H] 4 [C@H] F [NH+] S s Cl o [nH] [NH2+] [nH+] 5 [O-] # Br / "
    "[NH3+] [C@@] [C@] \\ [N-] 6 [n-] I [N+] - [S@@] [S@] [N] [H] [NH] [NH-] [C] 7 [S+] [n+] "
    "[CH] P . 8 [O+] [o+] [O] [NH2] 9 [CH-] [P] [Si] [C-] [s+] [OH+] [2H] %10 [NH3] [N@@] "
    "[CH2-] [C@@H-] [P+] [S-] [As] [N@] %11 [Br-] [Sn] [CH2] [I-] [Hg] B [SH] [*] [PH] [Cl-] "
    "[S] [B-] [AlH3] [Se] [C@H-] %12 [N@@+] [S@+] %13 [N@+] [Pt] [se] [cH-] [P@] [N@@H] "
    "[S@@+] [Cr] [Cl+3] [I+] [Cu] [P@@] [Zn+2] [c+] [Na+] [Te] [Fe] [c-] [IH2] [Ba+2] [Cd] "
    "[Au+] [Zn] [F] %14 [Bi] [Sb] [Mo] [Cu+2] p [N@H] [Cl] [Au] [In] [Pt+2] [Pd] [B] [N@H+] "
    "[3H] [NH4+] [Ca+2] [K+] [Hg+2] [Fe+2] [Co+2] [Fe+3] [SiH] [Ge] [Ag] [SH-] [Co] [Cu+] [V] "
    "[C@-] [13C] [H+] [Mg+2] [Zr] [Na] [Gd+3] [Co+] [Li+] [Ni+2] [Mn+2] [Ti] [Ni] [GaH3] [Ac] "
    "[BiH3] [Mo-2] [pH] [N++] [Br] [15N] [OH-] [TlH2+] [Ba] [Ag+] [Cr+3] [Nd] [Yb] [PbH2+2] "
    "[Cd+2] [SnH2+2] [Ti+2] [Dy] [Ca] [Sr+2] [Be+2] [Cr+2] [Mn+] [SbH6+3] [Au-] [Fe-] [Fe-2]"
).split(" ")

# Fixed value: the lexical pattern of the general molecule tokenizer.
GENERAL_MOLECULE_PATTERN = (
    r"\[[^\]]+]|Ru?|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$"
    r"|%[0-9]{2}|[0-9]"
)
