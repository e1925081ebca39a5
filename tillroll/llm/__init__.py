"""Operations for preparing training text at scale. Nothing outside imports this package."""
