import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Texts that every operator must stand: null, empty, white space only, one
#: word, unusual characters, a very long line, repeated rows.
HARD_TEXTS = [
    None, "", " ", "\n\n", "one", "two words", "tab\there   nbsp wide ", "  lead and  double  \n\n\ntrail \n",
    "café naïve \U0001F600\U0001F600 中文字 مرحبا", "it's we'll I'D 'S 123 4567,89!?",
    "<|endoftext|> </turn> \\### Assistant: x", "a" * 5000, ("lorem ipsum dolor " * 4000).strip(), "\x1c\x1d a\x1eb \x85",
    "same text twice here now and then", "same text twice here now and then",
]
