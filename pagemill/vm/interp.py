"""Stacks, execution, errors, and the two memories."""

from __future__ import annotations

from functools import lru_cache

from . import scanner
from .objects import MARK, UNLIMITED, Arr, Composite, Dic, File, FileRef, Name, Operator, PSError, Save, Store, Str, executable, is_number, key_of, name, syntax, type_name

#: Limits of the stacks, of saves and of nested handlers.
OPERANDS, DICTIONARIES, EXECUTION, SAVES, HANDLERS = 500, 20, 250, 15, 16
OPERATORS: dict[str, Operator] = {}
GRAPHICS: dict[str, Operator] = {}
PROCSETS: dict[str, dict[str, Operator]] = {}

ERRORS = (
    "dictfull dictstackoverflow dictstackunderflow execstackoverflow invalidaccess invalidexit invalidfileaccess invalidfont invalidrestore ioerror "
    "limitcheck nocurrentpoint rangecheck stackoverflow stackunderflow syntaxerror typecheck undefined undefinedfilename undefinedresult unmatchedmark vmfull"
).split()


def operator(text: str, kinds: str | None = "", into: dict[str, Operator] = OPERATORS):
    """Registers a function of (vm, operands). kinds has a letter per operand, the deepest first; None: the body looks at the stack."""

    def register(function):
        into[text] = Operator(text, kinds, function)
        return function

    return register


class Exit(Exception):
    pass


class Stop(Exception):
    pass


class Quit(Exception):
    pass


class OutOfBudget(Exception):
    pass


CHECKS = {
    "n": is_number,
    "i": lambda x: type(x) is int,
    "b": lambda x: type(x) is bool,
    "a": lambda x: type(x) is Arr,
    "s": lambda x: type(x) is Str,
    "d": lambda x: type(x) is Dic,
    "m": lambda x: type(x) is Name,
    "f": lambda x: type(x) is FileRef,
    "x": lambda x: True,
}


#: Fixed value: the random state of a fresh interpreter.
FIRST_SEED = 0x1D2B4A99


class Interp:
    def __init__(self, budget: int | None = None, files: dict[str, bytes] | None = None, graphics=None, clock: int | None = None, stdin: bytes = b"") -> None:
        self.ostack: list = []
        self.estack: list = []
        self.saves: list[tuple[Save, list, object]] = []
        self.serial = 0
        self.shared = True
        self.packing = False
        self.steps, self.budget = 0, budget
        self.out, self.err = bytearray(), bytearray()
        self.files, self.clock, self.stdin = files or {}, clock, File(stdin, label="%stdin")
        self.handlers = 0
        self.seed = FIRST_SEED
        self.depth = 0
        self.events: list[tuple] = []
        self.graphics = graphics
        self.fonts = 0
        self.parameters: dict[str, dict] = {}
        self.loops = 0
        self.system = self.dictionary()
        self.globals = self.dictionary()
        self.shared = False
        self.user, self.errors, self.error = self.dictionary(), self.dictionary(), self.dictionary()
        self.resources: dict[bool, dict[str, Dic]] = {True: {}, False: {}}
        self.system.store.data = _base(graphics is not None).copy()
        if graphics is not None:
            graphics.vm = self
        self.errors.store.data.update(_handlers())
        constants = {"systemdict": self.system, "globaldict": self.globals, "userdict": self.user, "errordict": self.errors, "$error": self.error, "true": True, "false": False, "null": None, "languagelevel": 3, "serialnumber": 0, "product": self.string(b"pagemill"), "version": self.string(b"3010"), "revision": 1, "statusdict": self.dictionary(), "serverdict": self.dictionary(), "FontDirectory": self.category("Font", False), "GlobalFontDirectory": self.category("Font", True)}
        for text, value in constants.items():
            self.system.store.data[text] = (name(text), value)
        for key in ("exitserver",):  # reached by this dictionary alone
            self.system.store.data["serverdict"][1].store.data[key] = self.system.store.data.pop(key)
        for key, value in (("newerror", False), ("errorname", None), ("command", None), ("ostack", None), ("estack", None), ("dstack", None), ("recordstacks", True)):
            self.error.store.data[key] = (name(key), value)
        self.dstack = [self.system, self.globals, self.user]
        self.floor = len(self.dstack)

    # -- memory -----------------------------------------------------------------------------------

    def store(self, data, capacity: int = 0) -> Store:
        return Store(data, self.shared, self.serial, capacity)

    def string(self, data: bytes, x: bool = False) -> Str:
        return Str(self.store(bytearray(data)), 0, len(data), x=x)

    def array(self, items: list, x: bool = False, packed: bool = False) -> Arr:
        if self.shared:
            for y in items:
                self.may_hold(True, y)
        return Arr(self.store(items), 0, len(items), 1 if packed else UNLIMITED, x, packed)

    def dictionary(self, capacity: int = 0) -> Dic:
        return Dic(self.store({}, capacity), 0, 0)

    def category(self, text: str, shared: bool) -> Dic:
        held = self.resources[shared] if hasattr(self, "resources") else None
        if held is None:
            return self.dictionary()
        if text not in held:
            was, self.shared = self.shared, shared
            held[text] = self.dictionary()
            held[text].store.born = held[text].store.stamp = 0
            self.shared = was
        return held[text]

    def touch(self, store: Store) -> None:
        """Keeps a copy of a local store that is about to change, once for each save."""
        if self.saves and not store.shared and store.stamp < self.saves[-1][0].serial:
            self.saves[-1][1].append((store, store.data.copy(), store.stamp, store.access))
            store.stamp = self.saves[-1][0].serial

    @staticmethod
    def may_hold(shared: bool, x) -> None:
        if shared and isinstance(x, Composite) and not x.store.shared:
            raise PSError("invalidaccess")

    def define(self, into: Dic, key, value) -> None:
        store = into.store
        if isinstance(key, str):
            key = name(key)
        elif type(key) is Str:
            key = name(key.text)
        elif type(key) is float and key.is_integer():
            key = int(key)
        self.may_hold(store.shared, key)
        self.may_hold(store.shared, value)
        self.touch(store)
        k = key_of(key)
        old = store.data.get(k)
        store.data[k] = (old[0] if old else key, value)

    def save(self) -> Save:
        if len(self.saves) >= SAVES:
            raise PSError("limitcheck")
        self.serial += 1
        saved = Save(self.serial)
        state = self.graphics.saved() if self.graphics is not None else None
        self.saves.append((saved, [], (state, self.shared, self.packing)))
        return saved

    def restore(self, saved: Save) -> None:
        if not saved.valid or all(s is not saved for s, _, _ in self.saves):
            raise PSError("invalidrestore")
        for x in (*self.ostack, *self.dstack, *self.estack):
            if isinstance(x, Composite) and not x.store.shared and x.store.born >= saved.serial:
                raise PSError("invalidrestore")
        while True:
            s, journal, state = self.saves.pop()
            s.valid = False
            for store, data, stamp, access in reversed(journal):
                store.data, store.stamp, store.access = data, stamp, access
            if s is saved:
                break
        self.shared, self.packing = state[1], state[2]
        if self.graphics is not None:
            self.graphics.restored(state[0])

    # -- stacks -----------------------------------------------------------------------------------

    def push(self, *values) -> None:
        self.ostack.extend(values)
        if len(self.ostack) > OPERANDS:
            del self.ostack[-len(values) :]
            raise PSError("stackoverflow")

    def pop(self):
        if not self.ostack:
            raise PSError("stackunderflow")
        return self.ostack.pop()

    def to_mark(self) -> list:
        """Takes what is above the topmost mark, and the mark."""
        for i in range(len(self.ostack) - 1, -1, -1):
            if self.ostack[i] is MARK:
                out = self.ostack[i + 1 :]
                del self.ostack[i:]
                return out
        raise PSError("unmatchedmark")

    def lookup(self, key):
        k = key_of(key)
        for d in reversed(self.dstack):
            hit = d.store.data.get(k)
            if hit is not None:
                return hit[1]
        raise PSError("undefined")

    def where(self, key) -> Dic | None:
        k = key_of(key)
        return next((d for d in reversed(self.dstack) if k in d.store.data), None)

    # -- execution --------------------------------------------------------------------------------

    def step(self) -> None:
        self.steps += 1
        if self.budget is not None and self.steps > self.budget:
            raise OutOfBudget

    def call(self, op: Operator) -> None:
        stack, kinds = self.ostack, op.kinds
        before = stack.copy()
        try:
            if kinds is None:
                op.run(self)
                return
            n = len(kinds)
            if len(stack) < n:
                raise PSError("stackunderflow")
            operands = stack[len(stack) - n :] if n else []
            for kind, x in zip(kinds, operands):
                if not CHECKS[kind](x):
                    raise PSError("typecheck")
            if n:
                del stack[-n:]
            op.run(self, *operands)
        except PSError as e:
            stack[:] = before
            self.fail(e.name, e.command or op)
        except RecursionError:
            stack[:] = before
            self.fail("execstackoverflow", op)
        except (ArithmeticError, ValueError):
            stack[:] = before
            self.fail("rangecheck", op)

    def fail(self, error: str, command) -> None:
        """Runs the handler of an error; a handler that returns lets the program go on."""
        if self.handlers >= HANDLERS:
            raise Stop
        self.handlers += 1
        try:
            if type(command) is Operator:
                command = name(command.text, True)
            if len(self.ostack) >= OPERANDS:
                self.ostack.pop()
            self.ostack.append(command)
            handler = self.errors.get(name(error))
            if handler is None:
                raise Stop
            self.run(handler)
        finally:
            self.handlers -= 1

    def execute_name(self, key: Name) -> None:
        try:
            value = self.lookup(key)
        except PSError as e:
            self.fail(e.name, key)
            return
        if type(value) is Operator:
            self.call(value)
        elif executable(value):
            try:
                self.run(value)
            except PSError as e:  # no room on the execution stack
                self.fail(e.name, key)
        else:
            self._push_value(value, key)

    def _push_value(self, value, command) -> None:
        try:
            self.push(value)
        except PSError as e:
            self.fail(e.name, command)

    def run(self, x) -> None:
        """Executes an object, a procedure by running its elements."""
        self.step()
        kind = type(x)
        if kind is Operator:
            self.call(x)
        elif not executable(x):
            self._push_value(x, x)
        elif kind is Name:
            self.execute_name(x)
        elif kind is Arr:
            self.enter(x)
            try:
                for y in x.items():
                    self.step()
                    kind = type(y)
                    if kind is Name and y.x:
                        self.execute_name(y)
                    elif kind is Operator:
                        self.call(y)
                    else:
                        self._push_value(y, y)
            finally:
                self.estack.pop()
        elif kind is Str:
            self.run_file(FileRef(File(x.bytes()), True))
        elif kind is FileRef:
            self.run_file(x)
        else:
            self._push_value(x, x)

    def enter(self, x) -> None:
        if len(self.estack) + self.loops >= EXECUTION:
            raise PSError("execstackoverflow")
        self.estack.append(x)

    def run_file(self, ref: FileRef) -> None:
        """Scans and executes a file to its end."""
        file = ref.file
        self.enter(ref)
        try:
            while file.open:
                try:
                    x = self.scan(file)
                except PSError as e:
                    file.at = len(file.data)
                    self.fail(e.name, e.command or name("--file--", True))
                    continue
                if x is scanner.END:
                    break
                self.step()
                kind = type(x)
                if kind is Name and x.x:
                    self.execute_name(x)
                else:
                    self._push_value(x, x)
        finally:
            self.estack.pop()

    def scan(self, file: File):
        """The next object of a file, END at its end."""
        found, file.at = scanner.token(file.data, file.at)
        return self.built(found, file, 0)

    def built(self, found, file: File, depth: int):
        if found is scanner.END:
            return found
        kind, value = found
        if kind == "number":
            return value
        if kind == "name":
            return name(value, True)
        if kind == "literal":
            return name(value)
        if kind == "string":
            return self.string(value)
        if kind == "immediate":
            try:
                return self.lookup(name(value))
            except PSError as e:
                raise PSError(e.name, name(value, True)) from None
        if kind == "close":
            raise PSError("syntaxerror", name("}", True))
        open_ = [[]]
        while open_:
            found, file.at = scanner.token(file.data, file.at)
            if found is scanner.END:
                raise PSError("syntaxerror", name("{", True))
            if found[0] == "open":
                if len(open_) >= scanner.MAX_NESTING:
                    raise PSError("limitcheck")
                open_.append([])
            elif found[0] == "close":
                done = self.array(open_.pop(), x=True, packed=self.packing)
                if not open_:
                    return done
                open_[-1].append(done)
            else:
                open_[-1].append(self.built(found, file, depth + 1))
        raise PSError("syntaxerror")

    def loop(self, body) -> None:
        """Runs body until it raises Exit; a loop takes a place on the execution stack."""
        if len(self.estack) + self.loops >= EXECUTION:
            raise PSError("execstackoverflow")
        self.loops += 1
        depth = len(self.estack)
        try:
            body()
        except Exit:
            del self.estack[depth:]
        finally:
            self.loops -= 1

    def stopped(self, x) -> bool:
        depth, loops = len(self.estack), self.loops
        try:
            self.run(x)
            return False
        except Stop:
            pass
        except Exit:
            self.estack_cut(depth, loops)
            self.try_fail("invalidexit", name("exit", True))
        except RecursionError:
            self.estack_cut(depth, loops)
            self.try_fail("execstackoverflow", x)
        self.estack_cut(depth, loops)
        return True

    def estack_cut(self, depth: int, loops: int) -> None:
        del self.estack[depth:]
        self.loops = loops

    def try_fail(self, error: str, command) -> None:
        try:
            self.fail(error, command)
        except Stop:
            pass

    def job(self, program: bytes) -> tuple[str, str | None, str | None]:
        """Runs a program: (ok, error or budget; the error's name; the offending command's text)."""
        self.current = FileRef(File(program, label="job"), True)
        try:
            if self.stopped(self.current):
                new = self.error.get(name("newerror"))
                if not new:
                    return "ok", None, None
                error, command = self.error.get(name("errorname")), self.error.get(name("command"))
                self.define(self.error, "newerror", True)
                handler = self.errors.get(name("handleerror"))
                if handler is not None:
                    self.stopped(handler)
                return "error", error.text if error else "unknown", syntax(command)
        except Quit:
            pass
        except OutOfBudget:
            return "budget", None, None
        return "ok", None, None


@lru_cache(maxsize=2)
def _base(graphics: bool) -> dict:
    """Entries of the system dictionary that are operators."""
    return {text: (name(text), op) for text, op in (OPERATORS | (GRAPHICS if graphics else {})).items()}


@lru_cache(maxsize=1)
def _handlers() -> dict:
    made = {e: (name(e), Operator(e, None, _default_handler(e))) for e in ERRORS}
    return made | {"handleerror": (name("handleerror"), Operator("handleerror", None, _report))}


def _default_handler(error: str):
    def handle(vm: Interp) -> None:
        command = vm.pop()
        e = vm.error
        was, vm.shared = vm.shared, False
        vm.define(e, "newerror", True)
        vm.define(e, "errorname", name(error))
        vm.define(e, "command", command)
        if e.get(name("recordstacks")) is True:
            vm.define(e, "ostack", vm.array(list(vm.ostack)))
            vm.define(e, "dstack", vm.array(list(vm.dstack)))
            vm.define(e, "estack", vm.array(list(vm.estack)))
        vm.shared = was
        raise Stop

    return handle


def _report(vm: Interp) -> None:
    e = vm.error
    if e.get(name("newerror")):
        vm.define(e, "newerror", False)
        error, command = e.get(name("errorname")), e.get(name("command"))
        text = command.text if isinstance(command, (Name, Str, Operator)) else syntax(command)
        vm.err += f"%%[ Error: {error.text if error else ''}; OffendingCommand: {text} ]%%\n".encode("latin-1", "replace")


__all__ = ["GRAPHICS", "OPERATORS", "PROCSETS", "Exit", "Interp", "OutOfBudget", "Quit", "Stop", "operator", "type_name"]
