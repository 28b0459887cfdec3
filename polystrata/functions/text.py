"""Functions of a search; a read answers them, as they need the read's own query and the collection's statistics."""

from __future__ import annotations

from . import WrongArguments, function

#: By name, how many arguments; operators.search has what they answer, and the language binds them.
OF_A_READ = {"search::score": (0, 2), "search::explain": (0, 2), "search::highlight": (1, 1), "search::ranks": (0, 0), "search::table_name": (0, 0), "search::snippet": (0, 0)}

for _name, (_least, _most) in OF_A_READ.items():

    def _unbound(*_, name=_name):
        raise WrongArguments(f"{name} is answered within a read: operators.search.rank, highlight and snippet, or the language's SELECT")

    function(_name, _least, _most)(_unbound)
