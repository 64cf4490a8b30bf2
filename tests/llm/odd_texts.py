#: Texts that no operator may stumble over.
ODD = [None, "", " ", "\n\n", "one", "ÀÉ ñ 漢字 🙂", "a" * 5000, "word " * 3000, "x\ny\nx\ny", "%%% *** &&&", "\u0000�", "tab\tcr\rnl\n"]
