"""How plans are cut, paged and stored."""
